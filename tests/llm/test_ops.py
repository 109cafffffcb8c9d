import gzip
import io
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lodestone.llm import chat, decontamination, line_dedup, media, mixing, registry, sharding, shared, simhash, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_agrees_with_sql(spark, same, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_decontamination_finds_substituted_passages_only(spark):
    item = words(40, 1)
    near = [("zzz" if i % 9 == 4 else w) for i, w in enumerate(item)]
    rows = [(1, " ".join(words(50, 2) + near + words(50, 3)), "a"), (2, " ".join(words(200, 4)), "a"), (3, None, "a"), (4, " ".join(item), "a"), (4, " ".join(item), "a"), (5, "", "a")]
    bench = spark.createDataFrame([(7, " ".join(item)), (9, " ".join(item)), (8, None), (10, "")], "item_id long, text string")
    d = docs(spark, rows)
    got = decontamination.find(d, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_items) for r in got) == [(1, 7, 2), (4, 7, 2), (4, 7, 2)]
    assert sorted(r.doc_id for r in decontamination.clean(d, bench).collect()) == [2, 3, 5]
    small = decontamination.find(d, bench.union(spark.createDataFrame([(11, " ".join(words(60, 4)))], bench.schema)), block_words=10)
    assert {r.doc_id for r in small.collect()} == {1, 2, 4}
    assert decontamination.find(d, bench.limit(0)).count() == 0 and decontamination.find(d.limit(0), bench).count() == 0


def test_stretch_against_brute_force():
    r = np.random.default_rng(5)
    for _ in range(200):
        a, b, d = r.integers(0, 3, 30).astype(np.uint64), r.integers(0, 3, 12).astype(np.uint64), int(r.integers(-5, 25))
        got, best = decontamination.stretch(a, b, d, 4, 0.8), None
        for s in range(max(d, 0), min(d + 12, 30)):
            for e in range(s + 4, min(d + 12, 30) + 1):
                k = int((a[s:e] == b[s - d : e - d]).sum())
                gain = k - 4 * (e - s - k)
                if best is None or gain > best:
                    best = gain
        if got:
            s, n, k = got
            assert k >= 0.8 * n and abs((k - 4 * (n - k)) - best) < 1e-6


def test_decontamination_misses_nothing_that_brute_force_finds():
    def brute(words, item):
        for d in range(-len(item), len(words) + 1):
            a, b, need = max(d, 0), min(d + len(item), len(words)), min(13, len(item))
            total = [0, *np.cumsum(words[a:b] == item[a - d : b - d])]
            if any(5 * (total[e] - total[s]) >= 4 * (e - s) for s in range(len(total)) for e in range(s + need, len(total))):
                return True
        return False

    r, found = np.random.default_rng(8), Counter()
    cases = [(16, (3,)), (10, (3, 6)), (5, (2,)), (13, (0, 5)), (15, (3, 7, 11)), (25, (4, 9, 14, 19, 24))]
    cases += [(n, tuple(r.choice(n, int(r.integers(0, n // 5 + 2)), replace=False))) for n in r.integers(1, 41, 400)]
    for n, places in cases:
        item = r.integers(0, 1 << 60, n).astype(np.uint64)
        near = item.copy()
        near[list(places)] = 1
        text = np.concatenate([r.integers(0, 1 << 60, int(r.integers(0, 20))).astype(np.uint64), near[int(r.integers(0, 3)) if n > 20 else 0 :], r.integers(0, 1 << 60, 5).astype(np.uint64)])
        got = decontamination.Block.build([(1, 1, item)]).matches(text, 13, 0.8)
        assert bool(got) == brute(text, item), (n, places)
        found[bool(got)] += 1
        for _, _, length, equal in got:
            assert length >= min(13, n) and 5 * equal >= 4 * length
    assert min(found.values()) >= 40


def test_decontamination_seeds_fit_wherever_words_differ():
    for n in range(13, 26):
        left = np.array([sum(1 << i for i in c) for c in combinations(range(n), n // 5)])
        for seed in decontamination.SEEDS:
            mask = sum(1 << i for i, bit in enumerate(seed) if bit == "1")
            for at in range(n - len(seed) + 1):
                left = left[(left & (mask << at)) != 0]
        assert not len(left)


def test_toxicity_rejects_disguised_insults(spark):
    lex = toxicity.Lexicon()
    d = docs(spark, [(1, "you stup1d wörthless m0ron", "a"), (2, "a calm note on gardens", "a"), (3, None, "a"), (4, "", "a")])
    assert sorted(r.doc_id for r in toxicity.reject(d, lex).collect()) == [2, 3, 4]
    assert toxicity.score(d.limit(0), lex).count() == 0


def test_sharding_splits_only_what_is_too_large(spark):
    rows = [(i, "x" * (i % 50), "a") for i in range(400)] + [(9000, "y" * 5000, "a"), (9001, None, "a")] + [(5, "z" * 40, "b")] * 60
    out = sharding.shard_rows(docs(spark, rows).withColumn("shard", F.col("lang")), limit=1000).collect()
    size, held = Counter(), Counter()
    for r in out:
        size[r.shard] += len(r.text or "")
        held[r.shard] += 1
    assert len(out) == len(rows) and all(size[s] <= 1000 or held[s] == 1 for s in size)
    names = set(size)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for s in names - {""}:  # the parent was too large
        assert sum(v for k, v in size.items() if k.startswith(s[:-1])) > 1000
    assert sharding.shard_rows(docs(spark, []), limit=10).count() == 0


def test_token_counts_do_not_depend_on_blocks(spark):
    enc = token_counts.encoder()
    rows = [(i, " ".join(words(i % 40, i)), "a") for i in range(60)] + [(60, None, "a"), (61, "<|endoftext|>", "a"), (61, "<|endoftext|>", "a")]
    order = token_counts.write_tokens(docs(spark, rows), shared.new_path(spark, "t"), file_tokens=500)
    want = Counter((i, len(enc.encode_ordinary(t or ""))) for i, t, _ in rows)
    wide = token_counts.write_tokens(docs(spark, rows), shared.new_path(spark, "t"), file_tokens=500, width=4)
    assert Counter(r.n_tokens for r in token_counts.scan(spark, wide.select("file"), block_bytes=64, width=4).collect()) == Counter(n for _, n in want.elements())
    with pytest.raises(Exception, match="out of bounds|OverflowError"):
        token_counts.write_tokens(docs(spark, rows[:2]), shared.new_path(spark, "t"), eod=70_000)
    for block in (8, 64, 1 << 20):
        got = order.join(token_counts.scan(spark, order.select("file"), block_bytes=block), ["file", "ordinal"]).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want and all(r.closed for r in got)


def test_warc_round_trip_for_any_range(spark):
    noise = "\x1f�" + "".join(chr(random.Random(3).randrange(32, 900)) for _ in range(3000))
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u\nv", None), (4, "u", ""), (5, "u", noise), (6, "u", "x" * 300_000), (None, "u", "same")]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), shared.new_path(spark, "w"))
    want = {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, len(noise.encode())), 6: ("response", None, 300_000), None: ("revisit", 2, 4)}
    for size in (7, 100, 1 << 20):
        got = warc.read(spark, files, range_bytes=size).collect()
        assert len(got) == 7 and {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got} == want
    assert next(bytes(r.payload) for r in got if r.page_id == 5) == noise.encode()
    one = warc.record(1, "u", b"p", None)
    assert gzip.decompress(one).startswith(b"WARC/1.1") and warc.member(io.BytesIO(b"\x1f\x8b\x08nothing"), 0) is None


def test_attempts_write_files_of_their_own(spark):
    d, p = docs(spark, [(i, "a b", "s") for i in range(9)]), spark.range(9).selectExpr("id as page_id", "'u' as url", "concat('x', id) as html")
    folder = shared.new_path(spark, "twice")
    a, b = (token_counts.write_tokens(d, folder, file_documents=2) for _ in range(2))
    assert a.groupBy("file").count().selectExpr("max(count) <= 2").first()[0] and not {r.file for r in a.collect()} & {r.file for r in b.collect()}
    assert [token_counts.scan(spark, x.select("file")).count() for x in (a, b)] == [9, 9]
    a, b = (warc.write(p, folder, file_bytes=1) for _ in range(2))
    assert not {r.file for r in a.collect()} & {r.file for r in b.collect()}
    assert [sorted(r.page_id for r in warc.read(spark, x).collect()) for x in (a, b)] == [list(range(9))] * 2


def test_tables_of_threads_and_marks_keep_apart(spark):
    from threading import Thread

    one = shared.save(spark.range(1), "one")
    before, got = shared.mark(), []
    two, three = (shared.save(spark.range(n), "more") for n in (2, 3))

    def other():
        mine = shared.mark()
        kept = [shared.save(spark.range(n), "other") for n in (4, 5)]
        shared.release(spark, mine)
        got.append(kept[1].count())

    t = Thread(target=other)
    t.start()
    t.join()
    assert got == [5] and two.count() == 2
    shared.drop(one)
    shared.release(spark, before)
    assert three.count() == 3
    with pytest.raises(Exception, match="(?i)path|file"):
        two.count()
    shared.release(spark, frozenset())
    assert three.count() == 3


def test_warc_reads_records_with_long_headers(spark):
    r = random.Random(6)
    urls = ["data:" + "".join(r.choice("abcdefghij0123456789") for _ in range(n)) for n in (65_000, 66_000, 300_000, 2_500_000)]
    files = warc.write(spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1), shared.new_path(spark, "w"))
    for size in (100_000, 1 << 24):
        assert {x.page_id: (x.url, bytes(x.payload)) for x in warc.read(spark, files, range_bytes=size).collect()} == {i: (u, f"p{i}".encode()) for i, u in enumerate(urls)}
    assert warc.member(io.BytesIO(gzip.compress(b"WARC/1.1 without an end")), 0) is None and warc.member(io.BytesIO(gzip.compress(b"WA")), 0) is None


def test_line_dedup_keeps_first_copies(spark):
    long = " ".join(words(60, 8))
    rows = [(1, "a b\nc d\ne f\ng\n" + long, "s"), (2, "x\na b\nc d\ne f\ny\n\n" + long + "\nz", "s"), (3, "a b\nc d", "s"), (4, None, "s"), (5, "", "s"), (6, "a b\nc d\ne f", "s")]
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("x\ny\n\nz", 4), 3: ("a b\nc d", 0), 4: (None, 0), 5: ("", 0), 6: ("", 3)}
    assert line_dedup.dedup(docs(spark, [])).count() == 0
    later, _ = line_dedup.later_windows(spark.createDataFrame([(1, 1, "p\nq\nr\ns\nt"), (2, 2, "q\nr\ns\nt\nu")], "uid long, doc long, text string"))
    assert [(r.uid, r.i, r.lines, r.first_uid, r.first_i) for r in line_dedup.runs(later).collect()] == [(2, 1, 4, 1, 2)]


def test_chat_fold_and_reversible_template(spark):
    ev = [
        (1, 1, "message", 0, "user", "hi"), (1, 2, "delta", 1, "assistant", "He"), (1, 3, "delta", 1, None, "llo"), (1, 4, "message", 2, "user", "more"), (1, 5, "regenerate", 1, None, None),
        (1, 6, "delta", 1, "assistant", "Yes"), (1, 7, "edit", 0, None, "hey"), (2, 1, "message", 0, "user", None),
    ]
    m = chat.fold(spark.createDataFrame(ev, "conv_id long, seq long, op string, turn long, role string, text string"))
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in m.collect()) == [(1, 0, "user", "hey"), (1, 1, "assistant", "Yes"), (2, 0, "user", "")]
    texts = ["</s>[INST] ok [/INST]", "\\l\\\\s<s>", "", "é𝄞[INST", "</s", None]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    p = chat.parse(chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), piece=4)).orderBy("piece").collect()
    assert [t.text for r in p for t in r.turns] == [t or "" for t in texts]
    assert [x for r in p for x in r.learned] == [t or "" for t in texts[1::2]]


def test_line_dedup_deletes_maximal_runs(spark, monkeypatch, same):
    seen, runs = [], line_dedup.runs
    monkeypatch.setattr(line_dedup, "runs", lambda later: seen.append(runs(later)) or seen[-1])
    rows = [(1, "p\nq\nr\ns\nt", "s"), (2, "q\nr\ns\nt\nu\nv\np\nq\nr", "s")]
    got = {r.doc_id: (r.text, r.lines_removed) for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("u\nv", 7)}
    assert sorted((r.i, r.lines, r.first_i) for r in seen[0].collect()) == [(1, 4, 2), (7, 3, 1)]


EVENTS = "conv_id long, seq long, op string, turn long, role string, text string"


def test_chat_fold_takes_the_last_of_repeated_and_tied_events(spark):
    ev = [
        (1, 1, "message", 0, "user", "hi"), (1, 1, "message", 0, "user", "hi"), (1, 2, "message", 1, "assistant", "a"), (1, 3, "edit", 1, None, "b"), (1, 3, "edit", 1, None, "b"),
        (2, 5, "message", 0, "user", "hey"), (2, 5, "edit", 0, "user", "hi"), (2, 5, "delta", 0, None, "!"), (2, 6, "delta", 0, None, "?"), (2, 6, "delta", 0, None, "?"), (None, None, "delta", None, "user", "x"),
    ]
    got = chat.fold(spark.createDataFrame(ev, EVENTS)).collect()
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in got) == Counter([(1, 0, "user", "hi"), (1, 1, "assistant", "b"), (2, 0, "user", "hi!??"), (None, None, "user", "x")])


def test_chat_fold_of_a_long_conversation_with_regenerations(spark):
    r, ev = random.Random(4), []
    for conv in (1, 1, 1, None, 2):
        for _ in range(400):
            ev.append((conv, len(ev), r.choice(["message", "edit", "delta", "delta", "delta", "regenerate"]), r.randrange(40), "user", f"{len(ev)} "))
    want = {}
    for conv, _, op, turn, _, text in ev:
        if op == "regenerate":
            want = {k: v for k, v in want.items() if k[0] != conv or k[1] < turn}
        want[conv, turn] = "" if op == "regenerate" else want.get((conv, turn), "") + text if op == "delta" else text
    ev = [(c, s, op, t, role, None if op == "regenerate" else x) for c, s, op, t, role, x in ev]
    r.shuffle(ev)
    assert {(x.conv_id, x.turn): x.text for x in chat.fold(spark.createDataFrame(ev, EVENTS)).collect()} == want


def test_chat_query_folds_a_log(spark, monkeypatch, same):
    called, fold = [], chat.fold
    monkeypatch.setattr(chat, "fold", lambda e: called.append(1) or fold(e))
    same(registry.QUERIES["op7_chat"](spark, SF), registry.ORACLES["op7_chat"])
    assert called
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, "b"), (1, None, "user", None), (None, 0, "user", "c")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter((r.conv_id, r.turn, r.role, r.text or "") for r in chat.fold(chat.log(m)).collect()) == Counter((c, t, role, x or "") for c, t, role, x in rows)


def test_mixing_meets_targets_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), None if i % 5 == 0 else f"s{i % 3}") for i in range(600)] + [(1, "w w w", "s0")] * 3
    got = [mixing.mix(docs(spark, rows)).collect() for _ in range(2)]
    assert Counter((r.doc_id, r.taken) for r in got[0]) == Counter((r.doc_id, r.taken) for r in got[1])
    taken, target = Counter(), {}
    for r in got[0]:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert len(got[0]) == len(rows) and all(abs(taken[s] - t) <= 17 for s, t in target.items())


def test_mixing_keeps_rows_that_differ_in_other_columns(spark):
    rows = [(1, "w w", "en", "a", None, {"k": 1}), (1, "w w", None, "a", "en", {"k": 1}), (1, "w w", "en", "a", None, {"k": 2}), (1, "w w", "de", "a", None, None), (1, "w w", "de", "a", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `x.y` string, m map<string,int>")
    got = mixing.mix_rows(d).collect()  # one source is taken as it is
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_simhash_links_against_brute_force(spark):
    base = words(60, 1)
    rows = [(i, " ".join(base[: 60 - i % 3]), "a") for i in range(12)] + [(20 + i, " ".join(words(5, i)), "a") for i in range(30)] + [(90, None, "a"), (91, " ", "a")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.link_fingerprints(docs(spark, rows)).collect()}
    fp = {i: simhash.majority(simhash.shingle_hashes((t or "").encode(), 3)) for i, t, _ in rows}
    near = defaultdict(set)
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                near[a].add(b)
    for i in fp:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (fp[i] - (1 << 64) if fp[i] >> 63 else fp[i], min(seen))


def test_keep_one_leaves_one_of_each_group(spark):
    a, b = words(200, 1), words(200, 2)
    rows = [(5, " ".join(a), "s"), (3, " ".join([*a[:199], "end"]), "s"), (7, " ".join(b), "s"), (7, " ".join(b), "s"), (9, " ".join(words(80, 3)), "s")]
    assert sorted(r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()) == [3, 7, 9]


def test_near_duplicates_meet_at_the_limit_whatever_their_length(spark):
    rows, pairs = [], {}
    for n, more in ((8, 1), (13, 2), (44, 10), (94, 20), (204, 45), (204, 52)):  # shingles in common, and those of one text alone
        for _ in range(60):
            i = 2 * len(pairs)
            text = words(n + more, i)
            rows += [(i, " ".join(text[:n]), "s"), (i + 1, " ".join(text), "s")]
            pairs[i] = 5 * (n - 4) >= 4 * (n - 4 + more)
    got = {r.doc_id: r.group_key for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert {i: got[i] == got[i + 1] for i in pairs} == pairs and Counter(pairs.values()) == {True: 300, False: 60}
    assert len(set(got.values())) == 300 + 2 * 60


def test_near_duplicates_bounds_lose_nothing():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.concatenate([r.permutation(a)[: int(len(a) * r.uniform(0.7, 1))], r.integers(0, 1 << 63, len(a) // 12).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert int(np.bitwise_count((simhash._bitmap(a) ^ simhash._bitmap(b)).view(np.uint64)).sum()) <= apart


def test_png_round_trip_checksums_and_all_filters():
    r = np.random.default_rng(1)
    for x in (r.integers(0, 256, (50, 64)), np.tile(np.arange(64), (9, 1)), np.zeros((1, 64)), np.repeat(r.integers(0, 256, (1, 64)), 20, 0)):
        x = x.astype(np.uint8)
        png = media.encode(x)
        assert (media.decode(png) == x).all() and len(media.cosine_hash(x)) == 8
    with pytest.raises(ValueError):
        media.decode(png[:30] + bytes([png[30] ^ 1]) + png[31:])
    with pytest.raises(ValueError):
        media.decode(png[:-3])
    lines = np.array([[4, 1, 2, 3], [3, 5, 6, 7], [4, 250, 1, 9]], np.uint8)
    assert media.unfilter(lines).tolist() == [[1, 3, 6], [5, 10, 15], [255, 0, 9]]  # by hand: Paeth, average, Paeth
    assert media.padded(b"") == bytes(64) and len(media.padded(b"x" * 64)) == 64


def test_media_query_reads_back_every_text(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op10_media"](spark, SF).collect()}
    import hashlib
    import zlib

    for d in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        raw = media.padded((d["text"] or "").encode())
        assert got[d["doc_id"]].payload_sha256 == hashlib.sha256(raw).hexdigest() and got[d["doc_id"]].tail_crc32 == zlib.crc32(raw[-64:])


def test_pipeline_keeps_columns_and_drops_what_it_should(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns[: len(source.columns)] == source.columns and out.count() > 0
    assert out.select(*source.columns).exceptAll(source).dropDuplicates(["doc_id"]).join(source, "doc_id", "left_anti").count() == 0
    assert decontamination.find(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0

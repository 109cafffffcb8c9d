"""Operators 11 to 13 against brute force written from their definitions, on odd tables; the labelled sample of operator 2."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import registry, repair, shared, spelling, substring, toxicity

SF = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, lang string, uid long, key string, word string"
BLANK = " \t\n\x0b\x0c\r"


def documents(spark, rows):
    """Rows with further columns of clashing names."""
    return spark.createDataFrame([(d, t, "xx", 1, "k", "w") for d, t in rows], TEXTS)


def source(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


# --- spelling variants ----------------------------------------------------------------------------


def brute_variants(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n > 1}
    letters = sorted(set("".join(words)))
    form, near = {}, {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters}
        found = [x for x in edits - {w} if x in words]
        near[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), words[w], near[w], words.get(form[w], 0)) for w in words)


def got_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def test_variants_of_the_smallest_documents(spark):
    assert got_variants(spelling.op11_spelling_variants(spark, SF)) == brute_variants(source(spark, "documents", "doc_id", "text"))


def test_variants_of_odd_texts(spark):
    rng = random.Random(2)
    stems = ["aaaaaaa", "aaaaaaab", "abababab", "éclairées", "Ünderway", "parallel", "parrallel", "paralel"]
    rows = [(None, None), (1, ""), (2, "x" * 3000 + " y"), (3, "x" * 3000 + " " + "x" * 2999), (4, "x" * 2999)]
    for i in range(400):
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿÀZ") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]])
        rows.append((rng.randrange(50), f"{w}, {rng.choice(stems)}. {rng.choice(stems)}×÷"))
    rows += rows[-40:]
    rows += [(i, "wordform wordform wordform wordformm") for i in range(40)] + [(900, "wordformmm wordformmm"), (901, "wordformmm")]
    got = got_variants(spelling.variants(documents(spark, rows)))
    assert got == brute_variants(rows) and any(r[1] for r in got)
    assert spelling.variants(documents(spark, [])).count() == 0


def test_forms_are_followed_to_the_last(spark):
    rows = [(1, "abcdefghi " * 1000 + "abcdefgh " * 60 + "abcdefg " * 3)]
    got = {r[0]: r for r in got_variants(spelling.variants(documents(spark, rows)))}
    assert got == {r[0]: r for r in brute_variants(rows)}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("e", "d")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(chain).collect()} == dict.fromkeys("abce", "d")


def test_deletion_keys_are_hashes_of_the_strings_left(monkeypatch):
    words = ["abcdefg", "abcdefh", "zbcdefg"]
    keys = spelling.deletion_keys(np.array([[ord(c) for c in w] for w in words], np.uint32))
    left = [[w[:i] + w[i + 1 :] for i in range(7)] + [w] for w in words]
    whole = {w: int(spelling.deletion_keys(np.array([[ord(c) for c in w]], np.uint32))[0, -1]) for row in left for w in row}
    assert [[int(k) for k in row] for row in keys] == [[whole[w] for w in row] for row in left]


def test_colliding_keys_join_nothing(spark, monkeypatch):
    members = [("abcdefg", 30, 2), ("abxdefg", 1, 2), ("qqqqqqqq", 5, 0), ("abdefg", 4, -1)]
    assert sorted(spelling.neighbours(members)) == [("abcdefg", 2, "abdefg", 4), ("abdefg", 2, "abcdefg", 30), ("abxdefg", 2, "abcdefg", 30)]


# --- conversation repair --------------------------------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """Every cheapest way is followed; the least by its letters is taken."""
    ids, by = {r[0] for r in rows}, defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            by[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for c in ids:
        turns = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            end = text.strip(BLANK)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))

        @cache
        def best(i, q, inserted=0):
            """(cost, letters, lines) of the rest."""
            ways = [(0, "", ())] if i == len(turns) and q in ("", "a") else []
            if inserted < 2:
                cost, letters, lines = best(i, NEXT[q], inserted + 1)
                ways.append((cost + 2, "I" + letters, (f"{NAMES[NEXT[q]]}:", *lines)))
            if i < len(turns):
                _, role, text = turns[i]
                cost, letters, lines = best(i + 1, q)
                ways.append((cost + 3, "D" + letters, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    if role[:1] == NEXT[q] or (role[:1] == "s" and not q):
                        cost, letters, lines = best(i + 1, role[:1])
                        ways.append((cost + more, "K" + letters, (f"{role}:{text}", *lines)))
                    cost, letters, lines = best(i + 1, NEXT[q])
                    ways.append((cost + 2 + more, "R" + letters, (f"{NAMES[NEXT[q]]}:{text}", *lines)))
            return min(ways, default=(10**9, "", ()))

        times = {t for t, *_ in turns if t is not None}
        initials = [r[1][:1] for r in turns]
        cost, audit, lines = best(0, "")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(times) - min(times) + 1 - len(times) if times else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def report(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_conversations():
    rng = random.Random(5)
    texts = ["Hi.", "Hi", " ", "", "Ok! ", "What?", "A.b", "End.\n", None, "yes "]
    roles = ["system", "user", "assistant"] * 2 + ["tool", None, "s", "", "ass", "ua"]
    rows = [(c, rng.choice([t, t, t, None]), rng.choice(roles), rng.choice(texts)) for c in [*range(150), None] for t in range(rng.randrange(1, 9))]
    return rows + [(7_000, t, "system", None) for t in range(3)]


@pytest.mark.parametrize("segment", [1 << 12, 2])
def test_repair_of_odd_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, seg string, pos long")
    got = report(repair.report(df.select("conv_id"), repair.damage(df)))
    assert got == brute_repair(rows)
    whole = re.compile(r"(s?(ua)+)?")
    placed = repair.numbered(repair.damage(df))
    told = repair.repaired(placed, repair.edits(repair.faults(placed))[1])
    lines = told.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nth", F.substring("role", 1, 1).alias("i")))), lambda x: x["i"]), "").alias("i")).collect()
    assert lines and all(whole.fullmatch(r.i) for r in lines)


def test_repair_of_the_smallest_conversations(spark):
    assert report(repair.op12_conversation_repair(spark, SF)) == brute_repair(source(spark, "conversations", "conv_id", "turn", "role", "text"))


def test_repair_of_one_long_conversation_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 64)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Hello.", f"So {t}.", "open", ""])) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import sys

    sys.setrecursionlimit(20_000)
    assert report(repair.report(df.select("conv_id"), repair.damage(df))) == brute_repair(rows)
    assert repair.report(df.limit(0).select("conv_id"), repair.damage(df.limit(0))).count() == 0


def test_the_automaton_has_few_states():
    rng = random.Random(3)
    table = repair.Table()
    for _ in range(300):
        table.scan([rng.randrange(16) for _ in range(200)], repair.END)
    assert len(table.vectors) < 60


# --- substring dedup ------------------------------------------------------------------------------


def brute_spans(rows):
    at = lambda d: float("inf") if d is None else d
    first, split = {}, [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, at(d)), at(d))
    out = []
    for d, w in split:
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < at(d) for j in range(13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cut(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256)).collect()), key=str)


@pytest.mark.parametrize("block", [1500, 1 << 20])
def test_spans_of_odd_documents(spark, block):
    rng = random.Random(3)
    word = lambda n, v: [str(rng.randrange(v)) for _ in range(n)]
    base, rows = [word(60, 50) for _ in range(12)], [(1, None), (2, ""), (3, "a" * 70_000), (None, "a" * 70_000 + " b")]
    for _ in range(250):
        w = []
        for _ in range(rng.randrange(6)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            w += b[a : a + rng.randrange(3, 45)] + (word(rng.randrange(8), 50) if rng.random() < 0.5 else [])
            if w and rng.random() < 0.3:
                w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
        w = ["w"] * rng.randrange(80) if rng.random() < 0.1 else w
        rows.append((rng.randrange(230) if rng.random() < 0.95 else None, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += rows[-10:]
    df = documents(spark, rows).withColumnsRenamed({"uid": "block", "key": "row", "word": "digest"})
    assert cut(substring.dedup(df, block_bytes=block)) == brute_spans(rows)
    assert substring.dedup(df.limit(0)).count() == 0


def test_spans_of_the_smallest_documents(spark):
    rows = source(spark, "documents", "doc_id", "text")
    got = sorted((tuple(r) for r in substring.op13_substring_dedup(spark, SF).collect()), key=str)
    assert got == brute_spans(rows) and sum(r[2] for r in got) > 0


def test_factors_are_greedy_and_true():
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n)).encode()
    ref = [text(200), text(150)]
    other = [ref[0][40:120] + b" x " + ref[1][10:90], text(60), b"", ref[1]]
    rows = np.array([0, 1, 0, 1])
    here, mine = substring.Reference(substring.Words(ref)), substring.Words(other)
    found = here.factors(mine, rows)
    assert found
    for i, c, n in found:
        t = int(mine.text[i])
        assert mine.words[i : i + n] == here.words.words[c : c + n] and int(here.words.text[c]) == rows[t]
        more = i + n < mine.bounds[t + 1] and c + n < here.words.bounds[rows[t] + 1]
        assert not more or mine.words[i + n] != here.words.words[c + n]
    has = here.holds(mine, rows)
    for i in range(len(mine.words)):
        t = int(mine.text[i])
        window, whole = mine.words[i : i + 13], here.words.words[here.words.bounds[rows[t]] : here.words.bounds[rows[t] + 1]]
        inside = i + 13 <= mine.bounds[t + 1] and any(whole[k : k + 13] == window for k in range(len(whole) - 12))
        assert bool(has[i]) == inside


def test_blocks_are_bounded_and_named_by_finished_tasks(spark):
    rows = [(i, f"{i} " * 200) for i in range(100)]
    folder, blocks = substring.write_blocks(documents(spark, rows), block_bytes=5000)
    told = blocks.collect()
    assert sum(r.n_docs for r in told) == 100 and len(told) > 5
    ids = [i for r in told for i in substring._open(folder, r.block)[1]]
    assert sorted(ids) == list(range(100))
    shared.remove(spark, folder)


# --- the labelled sample of operator 2 ------------------------------------------------------------


def test_texts_that_share_a_phrase_keep_their_labels(spark):
    rows = [(1, "you utter moron of the river bank go away now"), (0, "we sat by the bank of the river bank and read"), (1, "of the river bank"), (0, "of the river bank"), (0, "of the river bank"), (None, None), (0, "")]
    got = toxicity._signed_texts(spark.createDataFrame(rows, "toxic int, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted({(t, x or "") for t, x in rows}, key=str)


def test_matcher_equals_a_plain_search():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon(weights={"bad=": 2.0, "bad": 1.0, "badger=": 0.5, "ug": 0.25, "wors": 3.0}, exceptions=("bad luck", "ugly duck"))
    match = lexicon.matcher()
    words = ["bad", "b4d", "badger", "bads", "ugly", "duck", "luck", "worst", "WORSE", "ok", "sobad", "bäd"]
    for _ in range(400):
        text = rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randrange(12)))
        t = toxicity.fold(text)
        spared, total = set(), 0.0
        starts = [i for i in range(len(t)) if t[i].isalnum() and (i == 0 or not t[i - 1].isalnum())]
        ends = lambda i: i >= len(t) or not t[i].isalnum()
        for p in map(toxicity.fold, lexicon.exceptions):
            for i in starts:
                if t.startswith(p, i) and ends(i + len(p)):
                    spared |= set(range(i, i + len(p)))
        for i in starts:
            hits = [v for k, v in lexicon.weights.items() if t.startswith(k.removesuffix("="), i) and (not k.endswith("=") or ends(i + len(k) - 1))]
            if hits and i not in spared:
                total += max(hits)
        assert match(text) == (pytest.approx(total), len(t.split()))


def test_fit_is_the_same_from_rows_in_another_order(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(5), labels.repartition(3))
    assert one.weights == two.weights and one.curve == pytest.approx(two.curve)


def test_new_queries_are_registered():
    assert {"op11_spelling_variants", "op12_conversation_repair", "op13_substring_dedup"} <= set(registry.QUERIES)

from . import catalogue, code, detectors, reports, scans  # noqa: F401  (registers the queries of all)

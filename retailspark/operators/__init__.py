"""DataFrame -> DataFrame operators.

* ``daily``      sales extraction, daily aggregation, temperature fill, V_p, history (A1, A2, D1-D6)
* ``features``   the ten model features (B2-B6)
* ``alerts``     deviation and alert classification (B15-B17)
* ``reports``    weekly statistics, worst rows, top alerts, categories, documents, digest (B7, B8, B25, B28, D10-D14, E1-E3, F1, F2)
* ``ingest``     scans, half-hour packages, gateway enrichment, registrations, queue (A7, B10, B14, C1-C3, C8, D7-D9, D16, G2, G4)
* ``dashboard``  feed, alert parsing, search, deviation chart, series, stats (A10, B9, B11-B13, B26, B27, C9, C10, D17-D19, E5, E6)
* ``sessions``   gap sessionisation of key events (E4)
* ``models``     cold-start flags, training rows, moments, solve, incremental update, registry (H1-H3, H5, D13, D15, A12)
* ``scoring``    forecast days, fallback, assortment grid, scoring, keyed replace (A8, A9, A11, C4-C7, H4, H6)
* ``demand``     deterministic demand factors and seasonal temperature (B29, B30)
* ``ids``        contiguous ids and per-group ranks without hot-group windows
"""

"""Keywords of pages from all four sources, every one with all its pages."""

import re
from collections import defaultdict

from lotwise.plans import pages


def test_keywords_of_all_sources(spark):
    rows = [
        (1, "Red Paint | Blue paint — Glue", "Paint Shop", "Best paint. Fast; cheap! Ok", ["paint", " Glue "]),
        (2, "Glue", None, "x" * 100 + "," + "y" * 99, ["GLUE"]),
        (3, None, "Paint shop", None, []),
        (4, None, None, None, None),
    ] + [(10 + i, f"title{i}", f"heading {i}", None, []) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, title string, h1 string, description string, keywords array<string>")
    held = defaultdict(set)
    for i, title, h1, description, words in rows:
        of = {w.lower().strip() for w in words or []} | {w.strip().lower() for w in re.split("[|\\-–—,•·]", title or "") if len(w.strip()) > 2}
        of |= {w.strip().lower() for w in re.split("[.,;!?|•·\\-–—]", description or "") if 3 < len(w.strip()) < 100}
        for w in of | ({h1.lower().strip()} if h1 else set()):
            held[w].add(i)
    want = sorted((k, len(v), i) for k, v in held.items() for i in v)
    assert ("glue", 2, 2) in want and ("fast", 1, 1) in want and len(held) > 80
    got = [tuple(r) for r in pages.keyword_pages(df).collect()]
    assert sorted(got) == want and [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)

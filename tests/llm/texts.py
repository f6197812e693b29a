"""Small tables with the cases that every operator must settle."""

from __future__ import annotations

import random

SHARED = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def documents(spark, seed: int = 5, n: int = 60):
    """Nulls, empty and long texts, repeated rows and ids, near copies, a column that clashes with the operators' own."""
    random.seed(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        body = [random.choice(words) for _ in range(random.randint(1, 60))]
        if i % 4 == 0:
            body[3:3] = SHARED.split()[random.randint(0, 5) :]
        rows.append((i, random.choice([" ", "\n", "\t "]).join(body)))
    rows += [(100, rows[7][1]), (101, rows[7][1] + " extra"), (100, rows[7][1]), (None, SHARED), (None, None), (102, None), (103, ""), (104, " \n\t"), (105, "é" * 3000 + " " + SHARED * 40), (106, SHARED), (106, "other text of one id")]
    return spark.createDataFrame([(d, t, "x", 1, 2.0, "s", 3) for d, t in rows], "doc_id long, text string, source string, start int, score double, spans string, fp int")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def key(value):
    """Sorts nulls, too."""
    return tuple((x is not None, x if not isinstance(x, bool) else int(x)) for x in value)

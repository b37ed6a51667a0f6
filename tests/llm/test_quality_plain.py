"""The quality query from texts to decisions against plain Python: features, fit, sites, posteriors."""

from __future__ import annotations

import math

from lodemill.llm import quality


def shape(text: str | None) -> list[float]:
    """The thirteen features of a text, sign by sign and word by word."""
    text = text or ""
    signs = lambda chars: sum(c in chars for c in text)
    size, w = max(len(text.encode()), 1), text.split()
    n, upper, lower = max(len(w), 1), signs("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), signs("abcdefghijklmnopqrstuvwxyz")
    repeats = sum(a == b for a, b in zip(w, w[1:]))
    triples = len({tuple(w[k : k + 3]) for k in range(len(w) - 2)})
    return [
        math.log(1 + len(w)), min(math.log(1 + size / n), 4), min(signs("#$%&*+<=>@^_~`\\{}[]") / n, 3), upper / max(upper + lower, 1), signs("0123456789") / size, min(signs("|") / n, 1), min(signs("!") / n, 1),
        len(set(w)) / n, len(set(w)) / math.sqrt(n), repeats / n, triples / max(n - 2, 1), min(signs("\n") / n, 1), float(not w),
    ]


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """Linear equations by elimination."""
    rows = [[*r, x] for r, x in zip(a, b, strict=True)]
    n = len(rows)
    for k in range(n):
        best = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best] = rows[best], rows[k]
        for i in range(n):
            if i != k:
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k], strict=True)]
    return [rows[k][n] / rows[k][k] for k in range(n)]


def fitted(x: list[list[float]], y: list[int], l2: float) -> list[float]:
    """Weights of a logistic model, the bias last, where the slope of what it maximises is nil."""
    x = [[*r, 1.0] for r in x]
    n, w = len(x[0]), [0.0] * len(x[0])
    shrink = [l2] * (n - 1) + [1e-6]
    slope = [1.0]
    for _ in range(60):
        p = [1 / (1 + math.exp(-sum(a * b for a, b in zip(r, w, strict=True)))) for r in x]
        slope = [sum((t - q) * r[k] for r, t, q in zip(x, y, p, strict=True)) - shrink[k] * w[k] for k in range(n)]
        curve = [[sum(q * (1 - q) * r[i] * r[j] for r, q in zip(x, p, strict=True)) + (shrink[i] if i == j else 0) for j in range(n)] for i in range(n)]
        w = [a + b for a, b in zip(w, solved(curve, slope), strict=True)]
    assert max(map(abs, slope)) < 1e-6
    return w


def test_query_as_by_plain_python(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in docs and r["quality"] in (0, 1)}
    rows = {k: shape(r["text"]) for k, r in docs.items()}
    table = [rows[k] for k in sorted(labels)]
    middle = [sum(c) / len(c) for c in zip(*table, strict=True)]
    spread = [max(math.sqrt(sum((v - m) ** 2 for v in c) / len(c)), 1e-6) for c, m in zip(zip(*table, strict=True), middle, strict=True)]
    scale = lambda r: [(v - m) / s for v, m, s in zip(r, middle, spread, strict=True)]
    w = fitted([scale(r) for r in table], [labels[k] for k in sorted(labels)], 0.3)
    odds = {k: max(-8.0, min(8.0, sum(a * b for a, b in zip([*scale(r), 1.0], w, strict=True)))) for k, r in rows.items()}
    own = {k: 1 / (1 + math.exp(-v)) for k, v in odds.items()}

    n, mean = len(own), sum(own.values()) / len(own)
    hosts, paths = {}, {}
    for k, r in docs.items():
        hosts.setdefault(r["source"], []).append(own[k])
        paths.setdefault((r["source"], r["lang"]), []).append(own[k])
    average = lambda x: sum(x) / len(x)

    def strength(groups):
        spread = (sum(len(g) * (average(g) - centre) ** 2 for g, centre in groups) - (len(groups) - 1) * mean * (1 - mean)) / max(n - sum(len(g) ** 2 for g, _ in groups) / n, 1.0)
        return 10_000.0 if len(groups) < 2 or spread <= 0 else min(max(mean * (1 - mean) / spread - 1, 1.0), 10_000.0)

    over, inside = strength([(g, mean) for g in hosts.values()]), strength([(g, average(hosts[h])) for (h, _), g in paths.items()])
    of_host = {h: (sum(g) + over * mean) / (len(g) + over) for h, g in hosts.items()}
    of_path = {(h, p): (sum(g) + inside * of_host[h]) / (len(g) + inside) for (h, p), g in paths.items()}
    log_odds = lambda p: math.log(p / (1 - p))
    got = quality.query(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        k = r["doc_id"]
        site = docs[k]["source"], docs[k]["lang"]
        q = 1 / (1 + math.exp(-(log_odds(own[k]) + max(-1.5, min(1.5, log_odds(of_path[site]) - log_odds(mean))))))
        assert abs(r["own"] - own[k]) < 1e-4 and abs(r["host_posterior"] - of_host[site[0]]) < 1e-4 and abs(r["path_posterior"] - of_path[site]) < 1e-4
        assert abs(r["quality"] - q) < 1e-4 and (r["keep"] == (q >= 0.5) or abs(q - 0.5) < 1e-4), k
    assert 0 < sum(r["keep"] for r in got) < len(got)


def test_a_site_of_very_many_rows(spark):
    """The squares of a host's and a path's rows have more digits than a count."""
    rows = spark.range(1_200_000).selectExpr("if(id % 3 = 0, 'large', concat('h', id % 19)) as host", "if(id % 30 < 27, 'a', 'b') as path", "id % 10 / 10D as p")
    got = {(r["host"], r["path"]): r for r in quality.sites(rows).collect()}
    assert len(got) == 40 and all(0 < r["host_posterior"] < 1 and 0 < r["path_posterior"] < 1 for r in got.values())
    assert abs(got["large", "a"]["host_posterior"] - 0.45) < 0.01 and got["large", "a"]["prior"] == 0.45

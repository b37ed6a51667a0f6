"""The corpus operators against brute force on small fixtures, and on rows that are null, empty, repeated, long or oddly named."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemill.llm import bpe, components, decontaminate, line_dedup, quality, queries, simhash, sketch, suffix_dedup, toxicity, url_filter, warc

from ..compare import assert_same, connect

DOCS = "doc_id long, text string, lang string, source string, k string, id string, p string, host string"


def _random_texts(n: int, seed: int, words: int = 60) -> list[str]:
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary, words)) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, one key with two texts, a long text, and columns whose names clash."""
    a, b, c = _random_texts(3, 1)
    long = " ".join(_random_texts(120, 2)) + "\n" + "a" * 3000
    texts = [(1, a), (1, a), (1, b), (None, a), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, a + "\n" + c), (7, c + "\n" + a), (8, "x"), (9, "é中😀"), (10, a), (11, b + "!")]
    return [(k, t, "en", None if k == 2 else "s", "k", "i", "p", "h") for k, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 0), (6, None, None), (7, 9, 9), (99, 0, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(queries.ORACLES[name]).df())


# ---- 1: urls


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y", "x://net", "x://net/", "a://b://net/q", "x://.net/", "x://u@example.com:80/de/", "x://example.com/de", "x://É.org/fr/", "x://adult-x.example.com", "x://sub.adult-x.example.com#f", "x://notadult-x.example.com/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(4, urls[4], "clash")], "page_id long, url string, host string")
    rules = spark.createDataFrame(list(url_filter.RULES) + [("block", None), ("allow", "")], "action string, rule string")
    blocked = spark.createDataFrame([(h,) for h in url_filter.BLOCKED_HOSTS] + [(None,)], "key string")
    by_cascade = url_filter.judge(pages, rules, blocked)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in by_cascade.collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[5] == ("net", "", None, "allow") and got[6] == ("net", "/", "net/", "block")
    assert got[7] == ("b:", "//net/q", None, "allow") and got[8][2] == "net/" and got[10] == ("example.com", "/de", None, "allow") and got[11] == ("É.org", "/fr/", "org/fr/", "allow")
    assert [got[k][3] for k in (12, 13, 14)] == ["block", "block", "allow"]
    by_join = url_filter.judge(pages, rules, blocked, max_bits=32)
    assert sorted(map(str, by_join.collect())) == sorted(map(str, by_cascade.collect()))
    assert by_cascade.count() == len(urls) + 1 and url_filter.judge(pages.limit(0), rules, blocked).count() == 0
    assert url_filter.judge(pages, rules.limit(0), blocked.limit(0)).where("verdict != 'allow'").count() == 0


def test_cascade_is_exact_with_tiny_filters(spark):
    listed = spark.range(0, 300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    universe = spark.range(0, 3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    cascade = url_filter.build_cascade(listed, universe, bits_per_key=2, n_hashes=1)
    assert len(cascade.levels) > 2
    assert {r[0] for r in universe.where(cascade.has(F.col("key"))).collect()} == {f"k{i}" for i in range(300)}


def test_a_long_list_is_encoded_as_far_as_it_occurs(spark):
    name = lambda i: F.concat(F.lit("h"), i.cast("string"), F.lit(".example.com"))
    blocked = spark.range(200_000).select(name(F.col("id")).alias("key"))
    pages = spark.range(4000).select((F.col("id") * 100).alias("page_id"), F.concat(F.lit("x://www."), name(F.col("id") * 100), F.lit("/")).alias("url"), F.lit("own").alias("__keys"))
    got = url_filter.judge(pages, spark.createDataFrame([], "action string, rule string"), blocked)
    assert got.groupBy("verdict", "__keys").count().orderBy("verdict").collect() == [("allow", "own", 2000), ("block", "own", 2000)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    keys = pages.select(name(F.col("page_id")).alias("key"))
    assert [x.n_bits for x in url_filter.build_cascade(blocked, keys).levels][0] == 2000 * 12


# ---- 2 and 5: classifiers


def test_quality_on_held_out_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.score(docs, train).join(test.withColumnRenamed("quality", "truth"), F.col("key") == F.col("doc_id"))
    good, bad = got.where("truth = 1"), got.where("truth = 0")
    assert good.where("keep").count() >= 0.98 * good.count() and bad.where("not keep").count() >= 0.8 * bad.count()


def test_sparse_sites_shrink_to_their_host_and_to_the_corpus(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.1)] * 2 + [("tiny", "c", 0.1)] + [("bad", "d", 0.1)] * 300
    got = {(r["host"], r["path"]): r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    tiny, bad, b = got["tiny", "c"], got["bad", "d"], got["big", "b"]
    assert bad["host_posterior"] < tiny["host_posterior"] <= tiny["prior"] and b["path_posterior"] > 0.15


def test_posteriors_as_by_closed_form(spark):
    rng = np.random.default_rng(79)
    rows = [(f"h{h}" if h else None, f"p{p}", round(float(np.clip(rng.normal(0.3 + 0.05 * h + 0.02 * p, 0.1), 0, 1)), 6)) for h in range(8) for p in range(5) for _ in range(int(rng.integers(1, 40)))]
    got = {(r["host"], r["path"]): r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    table: dict = {}
    for h, p, x in rows:
        table.setdefault(h, {}).setdefault(p, []).append(x)
    everything = np.array([x for *_, x in rows])
    n, mean = len(everything), everything.mean()

    def strength(groups: list[tuple[list[float], float]]) -> float:
        sizes = np.array([len(g) for g, _ in groups])
        squares = sum(len(g) * (np.mean(g) - centre) ** 2 for g, centre in groups)
        spread = (squares - (len(groups) - 1) * mean * (1 - mean)) / (n - (sizes**2).sum() / n)
        return 10_000.0 if spread <= 0 else min(max(mean * (1 - mean) / spread - 1, 1.0), 10_000.0)

    hosts = {h: [x for g in paths.values() for x in g] for h, paths in table.items()}
    over, inside = strength([(g, mean) for g in hosts.values()]), strength([(g, np.mean(hosts[h])) for h, paths in table.items() for g in paths.values()])
    for h, paths in table.items():
        host = (sum(hosts[h]) + over * mean) / (len(hosts[h]) + over)
        for p, g in paths.items():
            assert abs(got[h, p]["host_posterior"] - host) < 1e-6 and abs(got[h, p]["path_posterior"] - (sum(g) + inside * host) / (len(g) + inside)) < 1e-6


def test_many_sites_are_joined_in_shards(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "h" if i % 3 else None, "p") for i in range(60)], "__id long, host string, path string")
    table = spark.createDataFrame([("h", "p", 0.5), (None, "p", 0.25)], "host string, path string, path_posterior double")
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)
    assert {(r["__id"], r["path_posterior"]) for r in quality.with_sites(rows, table).collect()} == {(i, 0.5 if i % 3 else 0.25) for i in range(60)}


def test_classifiers_on_odd_rows(spark, odd, none, labels):
    assert quality.score(odd, labels).count() == odd.count() and quality.score(none, labels).count() == 0
    assert quality.keep_good(odd, labels.limit(0)).count() == odd.count()
    assert quality.keep_good(odd, labels).columns == odd.columns
    scored = toxicity.classify(odd, labels, ["quality", "toxic"])
    assert scored.count() == odd.count() and scored.where("p_toxic is null or p_quality is null").count() == 0
    assert toxicity.classify(none, labels, ["toxic"]).count() == 0
    assert toxicity.classify(odd, labels.limit(0), ["toxic"]).where("p_toxic > 0.001").count() == 0


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    out = toxicity.classify(docs, labels.where("doc_id % 4 != 1"), ["toxic"], kinds=toxicity.KINDS).join(labels.where("doc_id % 4 = 1"), "doc_id")
    out = out.join(docs, "doc_id").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    hit = toxicity.THRESHOLD
    assert (toxic.p_toxic >= hit).mean() >= 0.9 and (clean.p_toxic >= hit).mean() <= 0.01
    for kind, seeds in toxicity.KINDS.items():
        own = toxic.text.str.lower().str.contains("|".join(seeds))
        assert (toxic[own][f"p_{kind}"] >= hit).mean() >= 0.9 and (clean[f"p_{kind}"] >= hit).mean() <= 0.01


def test_a_chain_as_by_plain_loops():
    rng = np.random.default_rng(5)
    n, terms = 300, [f"t{k}" for k in range(6)]
    held = rng.random((n, 6)) < 0.3
    first = (held[:, 0] | (rng.random(n) < 0.1)).astype(float)
    ys = np.column_stack([first, ((first > 0) & (rng.random(n) < 0.9)).astype(float)])
    rows, columns = np.nonzero(held)
    fold = np.arange(n) % 3
    masks = {(0, None): [0, 1], (0, 0): [0, 2], (0, 1): [0, 3], (0, 2): [0], (1, None): [4, 5]}
    chosen = {k: np.isin(np.arange(6), v) for k, v in masks.items()}
    chain = toxicity.fit_chain(rows, columns, fold, ys, terms, chosen)
    outside = np.zeros(n)
    for f in range(3):
        train = fold != f
        r, c = np.nonzero(held[train])
        w, _, b = toxicity._fit_one(r, c, chosen[0, f], np.zeros((int(train.sum()), 0)), ys[train, 0])
        outside[~train] = held[~train] @ w + b
    w, link, b = toxicity._fit_one(rows, columns, chosen[1, None], outside[:, None], ys[:, 1])
    assert np.allclose(chain.weights[1], w) and np.allclose(chain.links[1], link) and np.isclose(chain.bias[1], b)
    assert set(np.flatnonzero(chain.weights[0])) == {0, 1} and set(np.flatnonzero(chain.weights[1])) <= {4, 5} and link.sum() > 1
    # prediction with the model that was fitted, by plain loops
    got = chain.log_odds(rows, columns, n)
    for i in range(n):
        a = chain.bias[0] + sum(chain.weights[0][k] for k in range(6) if held[i, k])
        z = chain.bias[1] + sum(chain.weights[1][k] for k in range(6) if held[i, k]) + sum(link[j] for j, s in enumerate(toxicity.STEPS) if a >= s)
        assert abs(got[i, 0] - a) < 1e-9 and abs(got[i, 1] - z) < 1e-9


def test_terms_are_chosen_without_the_fold_that_they_predict(spark):
    rows = [(f, f"common only{f}" if y else "common", y) for f in range(3) for y in (0, 1) for _ in range(5)]
    counted = toxicity.count_terms(spark.createDataFrame(rows, "fold int, text string, toxic int"), ["toxic"], 3)
    totals = np.array([[10, 5]] * 3)
    assert "only1" in toxicity.choose_terms(counted, totals, 0, None, 50) and "only1" not in toxicity.choose_terms(counted, totals, 0, 1, 50)
    assert {"only0", "only2"} <= set(toxicity.choose_terms(counted, totals, 0, 1, 50))


def test_repeated_documents_do_not_swell_the_sample(spark):
    docs = spark.createDataFrame([(1, "you idiot " + str(k)) for k in range(50)] + [(2, "fine day"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels, ["toxic"], kinds=toxicity.KINDS).count() == 52
    assert quality.score(docs.selectExpr("*", "'s' source", "'en' lang"), labels.withColumnRenamed("toxic", "quality")).count() == 52


# ---- 3: repeated strings


def _removed(texts: list[bytes]) -> list[np.ndarray]:
    seen: set[bytes] = set()
    out = []
    for b in texts:
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - suffix_dedup.LENGTH + 1):
            s = b[k : k + suffix_dedup.LENGTH]
            if s in seen:
                cover[k : k + len(s)] = True
            seen.add(s)
        out.append(cover)
    return out


def _check_removal(spark, rows: list[tuple[int, str | None]], bases=None) -> None:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if bases is None:
        out = suffix_dedup.remove_repeats(docs)
    else:
        out = suffix_dedup._remove_repeats(docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text")), spark, 1, bases).withColumnRenamed("key", "doc_id")
    got = {r["doc_id"]: r for r in out.collect()}
    ordered = sorted(rows)
    texts = [(t or "").encode() for _, t in ordered]
    for (k, _), b, cover in zip(ordered, texts, _removed(texts), strict=True):
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        edge = np.flatnonzero(np.diff(np.r_[0, cover.astype(int), 0]))
        assert got[k]["n_bytes"] == len(b) and bytes(got[k]["kept"]) == kept, k
        assert [(s["start"], s["end"]) for s in got[k]["spans"]] == list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), k


def _repeating() -> list[tuple[int, str | None]]:
    base = _random_texts(6, 7, 80)
    rng = np.random.default_rng(8)
    rows = [(0, base[0]), (1, base[0][50:260] + base[1]), (2, "ab" * 400), (3, "a" * 1000), (4, base[1][3:103]), (5, base[1][3:102]), (6, None), (7, ""), (8, base[2] * 3), (9, base[0])]
    for k in range(10, 40):  # near copies
        t = list(base[k % 3 + 3])
        for at in rng.integers(0, len(t), 3):
            t[at] = "Z"
        rows.append((k, "".join(t)))
    return rows


def test_repeats_are_removed_as_by_brute_force(spark):
    _check_removal(spark, _repeating())


#: Different texts whose runs have equal anchors and equal hashes of their contents under BASE_B.
COLLIDE = ("mmmmmmmmmmmmmmmmmmmmmmmmhsreltpuscta pirhgwpr rpmuehueqmxavycfysbjya iptxmwznmxzsoeldbepgivnyujnq ms", "kmojiiknpomqnmonklqlknmmhsreltpuscta pirhgwpr rpmuehueqmxavycfysbjya iptxmwznmxzsoeldbepgivnyujnq ms")


def test_different_texts_with_equal_hashes_stay(spark):
    hashes = [suffix_dedup.runs_of(np.frombuffer(t.encode(), np.uint8), np.array([0, 100]), np.array([k]))[0] for k, t in enumerate(COLLIDE)]
    assert all(hashes[0][c] == hashes[1][c] for c in ("anchor", "content"))
    plain = _random_texts(3, 43, 60)
    rows = [(0, COLLIDE[0]), (1, COLLIDE[1]), (2, plain[0]), (3, COLLIDE[1] + plain[1]), (4, plain[0]), (5, COLLIDE[0])]
    for order in (rows, rows[:2], [rows[0], *rows[2:], rows[1]]):
        _check_removal(spark, order)
        _check_removal(spark, order, (int(suffix_dedup.BASE_B), None))


def test_contents_are_told_apart_by_bytes_wherever_a_hash_lies(spark):
    words = "abcd efgh ijkl mnop qrst".split()
    rng = np.random.default_rng(47)
    rows = [*_repeating(), *((100 + k, " ".join(rng.permutation(words * 8))) for k in range(40))]
    swapped = [(200 + k, t[:50] + t[51] + t[50] + t[52:] if len(t or "") > 60 else t) for k, t in rows]  # sums of bytes stay
    _check_removal(spark, rows + swapped, (1, None))
    _check_removal(spark, rows, (None,))


def test_windows_of_a_hot_anchor_are_dealt_by_distance(monkeypatch):
    rng = np.random.default_rng(53)
    text = _random_texts(1, 59, 120)[0]
    texts = []
    for _ in range(60):
        t = list(text)
        t[int(rng.integers(0, len(t)))] = "#"
        texts.append("".join(t).encode())
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    runs, place = suffix_dedup.runs_of(data, offsets, np.arange(len(texts)))
    parts = suffix_dedup.split_by_distance(runs)
    windows = lambda x: Counter((a, k, o + i) for a, k, o, n in zip(x["anchor"].tolist(), x["key"].tolist(), x["lo"].tolist(), x["n"].tolist(), strict=True) for i in range(n))
    assert windows(parts) == windows(runs) and len(parts) > 2 * len(runs)
    at = suffix_dedup.WINDOW // suffix_dedup.PARTS
    assert all(a // at == (a - n + 1) // at for a, n in zip(parts["at"].tolist(), parts["n"].tolist(), strict=True))
    padded = np.concatenate([data, np.zeros(suffix_dedup.LENGTH, np.uint8)])
    whole = suffix_dedup.repeats(runs, padded, place)
    found = [suffix_dedup.repeats(x, padded, offsets[x["key"]] + x["lo"]) for k in range(suffix_dedup.PARTS) for x in [parts[parts["at"] // at == k]]]
    assert suffix_dedup.merged(np.concatenate(found)).tolist() == suffix_dedup.merged(whole).tolist()


def test_long_texts_are_cut_into_segments():
    data = np.frombuffer((_random_texts(1, 9, 900)[0] * 2).encode(), np.uint8)
    whole, _ = suffix_dedup.runs_of(data, np.array([0, len(data)]), np.array([3]))
    old, suffix_dedup.SEGMENT = suffix_dedup.SEGMENT, 1000
    try:
        cut, place = suffix_dedup.runs_of(data, np.array([0, len(data)]), np.array([3]))
    finally:
        suffix_dedup.SEGMENT = old
    windows = lambda runs: Counter(int(lo) + k for lo, n in zip(runs["lo"], runs["n"], strict=True) for k in range(n))
    assert windows(whole) == windows(cut) == Counter(range(len(data) - suffix_dedup.LENGTH + 1)) and cut["lo"].tolist() == place.tolist()


def test_a_hash_that_lies_is_found_out(monkeypatch):
    data = np.frombuffer(("".join(_random_texts(1, 11, 200)))[:800].encode()[:700], np.uint8)
    runs = np.zeros(2, suffix_dedup.RUN)
    runs["key"], runs["n"] = [1, 2], 1
    monkeypatch.setattr(suffix_dedup.Suffixes, "common", lambda self, x, y: np.full(len(x), suffix_dedup.LENGTH))
    assert len(suffix_dedup.repeats(runs, data, np.array([0, 300]))) == 0


def test_removal_on_odd_rows(spark, odd, none):
    got = suffix_dedup.remove_repeats(odd)
    assert got.count() == odd.count() and suffix_dedup.remove_repeats(none).count() == 0
    first = [r["n_bytes"] - len(r["kept"]) for r in got.where("doc_id is null and n_bytes > 0").collect()]
    assert first == [0]  # a null key comes first
    twice = [(r["n_bytes"], bytes(r["kept"])) for r in got.where("doc_id = 1").collect()]
    assert len(twice) == 3 and len(set(twice)) == 2


# ---- 4: sketches


def test_likeness_as_by_counting(spark):
    texts = _random_texts(12, 13, 50)
    rows = [(k, ". ".join(t.split(" ")[:30]) + "\n" + t) for k, t in enumerate(texts)] + [(20, None), (21, ""), (22, "a. " * 3000), (23, "a. " * 2500), (24, "b" * 3000)]
    got = {r["doc_id"]: r for r in sketch.compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (k, t) in enumerate(rows):
        t, y = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 4] + y[: len(t) // 4]

        def near(a, b):
            x, z = Counter(sketch.paragraphs(a)), Counter(sketch.paragraphs(b))
            return (x & z).total() / (x | z).total() if (x | z) else 1.0

        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert abs(got[k]["near_edited"] - near(t, e)) < 1e-9 and abs(got[k]["near_next"] - near(t, y)) < 1e-9
        following = got[rows[(i + 1) % len(rows)][0]]["fingerprint"]
        # from the stored strings alone
        assert sketch.likeness_of(got[k]["fingerprint"], got[k]["edited_fingerprint"]) == got[k]["near_edited"]
        assert sketch.likeness_of(got[k]["fingerprint"], following) == got[k]["near_next"]


def test_few_changes_are_found_in_a_small_sketch():
    rng = np.random.default_rng(73)
    base = rng.integers(1, 1 << 48, 5000, dtype=np.uint64)
    other = np.concatenate([base[3:], rng.integers(1, 1 << 48, 2, dtype=np.uint64)])
    a, b = sketch.Fingerprints.of([base]), sketch.Fingerprints.of([other])
    assert [int(x.cells[0]) for x, _ in a.levels] == [12, 48, 192, 768, 3072] and a.last.cells[0] >= 7500
    keys, _, whole = a.levels[0][0].minus(b.levels[0][0]).peel()
    assert whole.all() and set(keys.tolist()) == set(base[:3].tolist()) | set(other[-2:].tolist())
    assert sketch.differences(a, b).tolist() == [5] and sketch.differences(a, a).tolist() == [0]
    assert sketch.Fingerprints.read(a.written()).written() == a.written()


def test_small_differences_as_by_exact_counts():
    """Random differences of 1 to 9 digests in sketches of 12 cells: whatever comes out whole is exact."""
    rng, n = np.random.default_rng(79), 400_000
    sizes = rng.integers(1, 10, n)
    owner = np.repeat(np.arange(n), sizes)
    keys, sign = rng.integers(0, 1 << 64, len(owner), dtype=np.uint64), rng.choice([-1, 1], len(owner))
    got, of, whole = sketch.Sketches(np.full(n, 12)).add(keys, owner, sign).peel()
    assert (np.bincount(of, minlength=n)[whole] == sizes[whole]).all() and whole[sizes < 3].mean() > 0.8
    wanted = {(k, o) for k, o in zip(keys.tolist(), owner.tolist(), strict=True)}
    assert all((k, o) in wanted for k, o, w in zip(got.tolist(), of.tolist(), whole[of].tolist(), strict=True) if w)


def test_a_document_is_peeled_alike_whatever_stands_beside_it():
    rng = np.random.default_rng(83)
    documents = [rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (2, 7, 5, 900, 3)]
    build = lambda some: sketch.Sketches(np.full(len(some), 12)).add(np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some]), 1)
    keys, owner, whole = build(documents).peel()
    for i, d in enumerate(documents):
        alone = build([d]).peel()
        assert sorted(keys[owner == i].tolist()) == sorted(alone[0].tolist()) and whole[i] == alone[2][0]


def test_a_digest_that_is_taken_out_and_put_back_is_none(monkeypatch):
    """With checks that always fit, false digests come up; they may leave a sketch unpeeled, and may not be counted."""
    monkeypatch.setattr(sketch, "check_of", lambda keys: np.zeros(len(keys), np.uint64))
    rng, n = np.random.default_rng(89), 20_000
    owner = np.repeat(np.arange(n), 5)
    got, of, whole = sketch.Sketches(np.full(n, 12)).add(rng.integers(0, 1 << 64, 5 * n, dtype=np.uint64), owner, rng.choice([-1, 1], 5 * n)).peel()
    assert len(np.unique(np.stack([of.astype(np.uint64), got], axis=1), axis=0)) == len(got) and whole.any() and not whole.all()


def test_ranges_pass_their_first_document_on(spark):
    rows = [(None if k % 3 == 0 else "hot" if k % 3 == 1 else f"k{k:03d}", f"{k:04d}" * 4) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    got = sketch.compare_versions(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows) and len({r["edited_sha256"] for r in got}) == 300
    dealt = sketch.with_next(docs, "doc_id", "text").where("own").groupBy("part").count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 100


def test_sketches_on_odd_rows(spark, odd, none):
    got = sketch.compare_versions(odd).collect()
    assert len(got) == odd.count() and sketch.compare_versions(none).count() == 0
    by_text: dict[str, set] = {}
    for r, (_, t, *_rest) in ((r, o) for r in got for o in odd_rows() if o[0] == r["doc_id"] and r["n_chars"] == len(o[1] or "")):
        by_text.setdefault(t or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert sketch.compare_versions(odd.where("doc_id = 8")).first()["near_next"] == 1.0
    assert all("".join(sketch.paragraphs(t)) == t for t in ("", "a", "a.b. c\n\nd", "x " * 500, "y" * 2000))


# ---- 6: SimHash


def _simhash(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_and_components(spark, odd, none):
    rows = odd_rows() + [(100 + k, t, "en", "s", "", "", "", "") for k, t in enumerate(_random_texts(40, 17, 400))]
    rows += [(200 + k, r[1] + " one more", *r[2:]) for k, r in enumerate(rows[15:35])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fps = {t or "": _simhash(t) for _, t, *_ in rows}
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got) == Counter((r[0], fps[r[1] or ""]) for r in rows)
    values = sorted(set(fps.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, t, *_ in rows:
        if k is not None:
            least[find(fps[t or ""])] = min(k, least.get(find(fps[t or ""]), 1 << 60))
    assert all(r["component_id"] == least.get(find(r["fp"] & (1 << 64) - 1)) for r in got)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(odd).columns == odd.columns


def _linked(found, values: np.ndarray, radius: int) -> None:
    groups = {r["node"]: r["root"] for r in components.components(found).collect()}
    signed = values.view(np.int64).tolist()
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            assert groups[signed[i]] == groups[signed[i + 1 + j]]
    assert found.count() <= 4 * len(values)


def _crowd(n: int, seed: int, base: int = 0x0123456789ABCDEF, flips: int = 6) -> np.ndarray:
    """Fingerprints that lie within a few bits of one."""
    rng = np.random.default_rng(seed)
    return np.unique(np.array([base ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, flips + 1), replace=False)) for _ in range(n)], np.uint64))


def test_links_reach_every_pair_whatever_the_tree(spark):
    rng = np.random.default_rng(19)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 5), replace=False))) for b in base for _ in range(5)]
    for values in (np.unique(np.concatenate([base, np.array(near, np.uint64)])), _crowd(400, 63)):
        for leaf, sample in ((1 << 16, 1000), (40, 1000), (3, 60)):
            found = simhash.links(spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long"), 3, leaf, sample)
            _linked(found, values, 3)
    assert simhash.links(spark.createDataFrame([], "fp long")).count() == 0


def test_the_tree_meets_each_pair_in_one_shard_and_compares_few(monkeypatch):
    monkeypatch.setattr(simhash, "COMPARED", 1 << 10)
    rng = np.random.default_rng(67)
    for make in (lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)), lambda n: _crowd(n, 71, flips=12)):
        cost = []
        for n in (3_000, 30_000):
            values = make(n)
            tree = simhash.Tree(values[:: n // 1000], n / 1000, 500)
            shard, fps, home = simhash.shards_of(tree, values, 3)
            assert max(x.parts for x in tree.leaves) == 1 and np.array_equal(np.sort(fps[home]), values) and np.bincount(shard[home]).max() < n / 4
            compared = 0
            for s in np.unique(shard)[:: 1 if n == 3_000 else 10]:
                compared += simhash._groups(fps[shard == s], home[shard == s], 3)[2] * (1 if n == 3_000 else 10)
            cost.append(compared)
        assert cost[1] < 30 * cost[0]  # ten times the input; the square would be a hundred


def test_the_stage_finds_texts_of_similar_shingles(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(29)
    texts = _random_texts(60, 31, 150) + _random_texts(20, 33, 8)
    for t in texts[:80]:
        for changes in (1, 2, 3, 4, 6):
            w = t.split()
            for at in rng.integers(0, len(w), changes if len(w) > 8 else 0):
                w[at] = "other"
            texts.append(" ".join([*w, "end"]))
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])]
    known = components.components(spark.createDataFrame(near, "a long, b long")).collect()
    least = {k: k for k in range(len(texts))} | {r["node"]: r["root"] for r in known}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (simhash.BLOCK, 50):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
        assert got == least and len(set(least.values())) < len(texts) - 100
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == set(least.values())
    assert simhash.keep_first(none).count() == 0
    kept = Counter(r["doc_id"] for r in simhash.keep_first(odd).collect())
    assert kept == Counter({1: 3, None: 2, 2: 1, 5: 1, 6: 1, 8: 1, 9: 1})


def test_the_stage_takes_the_groups_of_the_operator(spark):
    """A text whose repeats outweigh what is its own has the fingerprint of another one, though their sets of shingles are not similar; groups of both ways join."""
    base, other, third = _random_texts(3, 101, 300)
    repeated = " ".join([base] * 40)
    near = " ".join([base] * 40 + [other])
    ends = near.split()
    ends[-1] = "end"
    rows = [(7, near), (9, repeated), (11, " ".join(ends)), (4, third), (5, third + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    sets = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert bits[9] == 7 and sets[9] == 9 and sets[5] == 4
    assert {r["doc_id"]: r["component_id"] for r in simhash.duplicates(docs).collect()} == {4: 4, 5: 4, 7: 7, 9: 7, 11: 7}
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == {4, 7}
    twice = docs.union(docs.where("doc_id in (5, 9)")).union(spark.createDataFrame([(None, third)], docs.schema))
    assert Counter(r["doc_id"] for r in simhash.keep_first(twice).collect()) == {4: 1, 7: 1, None: 1}


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 30)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {1000 + k: 1000 for k in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7: benchmark


ITEM = "A train leaves Paris at 9 and covers 120 km in 2 hours while Anna reads 3 books on her way to Lyon"


def test_reparameterised_questions_are_leaks(spark, odd, none):
    other = ITEM.replace("120", "450").replace("Anna", "Mary").replace("9", "7").replace("Paris", "Turin")
    twisted = "Item: " + re.sub(r"\d+", lambda m: str(int(m[0]) * 7), ITEM)
    filler = _random_texts(1, 23, 200)[0]
    rows = [(1, filler + " " + ITEM + " " + filler), (2, filler + ". " + other), (3, filler), (4, ITEM[:40]), (5, twisted), (6, None), (7, ""), (8, filler + "\n" + ITEM)]
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, "two words"), (4, "12 34 56 78 90 12 34 56 78 90"), (5, "one two three four five")], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {(r["key"], r["item"]) for r in found.collect()} == {(1, 1), (2, 1), (5, 1), (8, 1)}
    assert decontaminate.leaks(odd, items).count() == 0 and decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    kept = decontaminate.drop_leaks(odd, items)
    assert kept.count() == odd.count() and kept.columns == odd.columns


def test_slots_have_to_be_consistent(spark):
    item = "the box holds 4 red balls and the bag holds 4 blue balls and the jar holds 4 green balls and the can holds 4 black balls"
    same, mixed = item.replace("4", "9"), re.sub("4", lambda m, k=iter("5678"): next(k), item)
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    assert {r["key"] for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()} == {1}


def test_items_rich_in_numbers_and_names_are_caught(spark):
    texts = [
        "Find the next number in the sequence: 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024.",
        "Given the matrix [[1, 2, 3], [4, 5, 6], [7, 8, 10]], what is the determinant of the matrix?",
        "Sort these ten cities by the alphabet: in Paris, London, Rome, Oslo, Turin, Madrid, Vienna, Berlin, Prague, Athens.",
        "What is 12 + 15 + 18 + 21 + 24 + 27 + 30 + 33?",
        "What is 2 + 2?",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    filler = _random_texts(1, 37, 200)[0]
    rows = [(k, f"{filler} {t} {filler}") for k, t in enumerate(texts)] + [(10, texts[3].replace("21", "20").replace("24", "23").replace("15", "14").replace("30", "31")), (11, "What is 2 + 3?"), (12, filler)]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["key"], r["item"]) for r in found} == {(k, k) for k in range(5)}


def test_a_repeated_turn_is_no_leak(spark):
    item = "which of the following is not an example of renewable energy sources used today"
    turn = "which of the following is not an"
    docs = [(1, ". ".join(f"{k}) {turn} example: {w}" for k, w in enumerate(_random_texts(20, 41, 5)))), (2, item), (3, f"{item}. {item}")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r["key"], r["windows"]) for r in found.collect()} == {(2, 7), (3, 7)}


def _plain_tokens(text: str) -> list[tuple[str, str]]:
    """Template and own form of each token, by a scan from left to right."""
    import unicodedata

    letter = lambda c: unicodedata.category(c).startswith("L")
    number = lambda c: unicodedata.category(c).startswith("N")
    sign = lambda c: letter(c) and any(a <= c <= b for a, b in ("\u0e00\u0eff", "\u3040\u30ff", "\u3400\u9fff"))

    def word(i: int) -> int:
        while i < len(text) and letter(text[i]):
            i += 1
        return i

    def name(i: int) -> int:
        """The end of a capitalised word that is no common one, or i."""
        j = word(i)
        return j if j > i and unicodedata.category(text[i]) == "Lu" and text[i:j] not in decontaminate.COMMON else i

    out, i = [], 0
    while i < len(text):
        if letter(text[i]) and (end := name(i)) > i and (i == 0 or not letter(text[i - 1])):
            for _ in range(7):
                j = end
                while j < len(text) and text[j] == " " and j - end < 3:
                    j += 1
                if j == end or (k := name(j)) == j:
                    break
                end = k
            out.append((decontaminate.NAME, text[i:end]))
            i = end
        elif sign(text[i]):
            out.append((text[i], text[i]))
            i += 1
        elif letter(text[i]):
            j = i
            while j < len(text) and letter(text[j]) and not sign(text[j]):
                j += 1
            unit = bool(out) and out[-1][0] == decontaminate.NUMBER and text[i:j].lower() in decontaminate.UNITS and text[:i].rstrip(" ").endswith(out[-1][1])
            out.append((decontaminate.UNIT if unit else text[i:j].lower(), text[i:j]))
            i = j
        elif number(text[i]):
            j = i
            while j < len(text) and (number(text[j]) or (text[j] in ".," and j + 1 < len(text) and number(text[j + 1]))):
                j += 1
            out.append((decontaminate.NUMBER, text[i:j]))
            i = j
        else:
            i += 1
    return out


def _plain_leaks(docs: dict[int, str], items: dict[int, str]) -> set[tuple[int, int]]:
    kinds = (decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT)
    out = set()
    split = {d: _plain_tokens(text or "") for d, text in docs.items()}
    for i, item in items.items():
        tokens = _plain_tokens(item)
        n = min(len(tokens), decontaminate.WINDOW)
        starts = list(range(len(tokens) - n + 1))
        left = [a for a in starts if sum(t not in kinds for t, _ in tokens[a : a + n]) >= decontaminate.LEAST_WORDS]
        forms = [(False, left)] if len(left) >= decontaminate.FEW or len(left) == len(starts) else []
        if len(left) < decontaminate.FEW:
            forms.append((True, starts))
        for d, own in split.items():
            if len(tokens) < decontaminate.LEAST_WORDS:
                if tokens and [x.lower() for _, x in own] == [x.lower() for _, x in tokens]:
                    out.add((d, i))
                continue
            for literal, at in forms:
                form = lambda pair, literal=literal: pair[1].lower() if literal else pair[0]
                diagonals: dict[int, list[int]] = {}
                windows: dict[tuple, list[int]] = {}
                for b in range(len(own) - n + 1):
                    windows.setdefault(tuple(map(form, own[b : b + n])), []).append(b)
                for a in at:
                    for b in windows.get(tuple(map(form, tokens[a : a + n])), ()):
                        diagonals.setdefault(b - a, []).append(a)
                held = set()
                for shift, places in diagonals.items():
                    values: dict[tuple, set] = {}
                    for a in places:
                        for k in range(n):
                            if not literal and tokens[a + k][0] in kinds:
                                values.setdefault(tokens[a + k], set()).add(own[a + shift + k][1])
                    if sum(len(v) == 1 for v in values.values()) >= decontaminate.CONSISTENT * len(values):
                        held.update(places)
                if at and len(held) >= min(-(-len(at) // 2), decontaminate.ENOUGH):
                    out.add((d, i))
    return out


def test_leaks_as_by_plain_loops(spark):
    rng = np.random.default_rng(83)
    words = "the a box ball red holds gives of and with then green takes km kg 5 12 3,5 7.25 Anna Tom Lyon New York The What I 中 文 字 é ü".split()
    items = {k: " ".join(rng.choice(words, rng.integers(1, 30))) for k in range(40)}
    items |= {50: ITEM, 51: "这是一个关于火车速度的问题请回答", 52: "What is love", 53: "Yes", 54: "!!!", 55: "Paris, Rome and Tom Jones"}
    docs = {}
    for k in range(120):
        item = items[int(rng.choice(list(items)))]
        if k % 3 == 0:
            item = item.replace("Anna", "Mary Ann").replace("12", "99").replace("Tom", "Bob").replace("Paris", "New Orleans")
        if k % 5 == 0:
            item = re.sub(r"\d+", lambda m: str(rng.integers(1, 9)), item)
        docs[k] = " ".join([*rng.choice(words, rng.integers(0, 25)), item, *rng.choice(words, rng.integers(0, 25))])
    docs |= {200: items[51], 201: "前面" + items[51] + "后面", 202: "what is love?", 203: "Yes", 204: "Yes, yes", 205: ITEM.replace("Paris", "New York").replace("Anna", "Tom Jones"), 206: "Tell me: " + ITEM, 207: "中" * 30}
    found = decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got, expected = {(r["key"], r["item"]) for r in found.collect()}, _plain_leaks(docs, items)
    assert got == expected and {(200, 51), (201, 51), (202, 52), (203, 53), (205, 50), (206, 50)} <= got and len(got) >= 100


def test_very_long_numbers_and_names_do_not_overflow(spark):
    docs = [(1, ",".join(map(str, range(30_000)))), (2, " ".join(["Aa"] * 50_000)), (3, "x" * 500_000), (4, "1" * 300_000), (5, "Zz" * 200_000), (6, ITEM)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", ITEM)], "item_id string, text string"))
    assert [(r["key"], r["item"]) for r in found.collect()] == [(6, "i")]


def test_a_large_benchmark_is_joined(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    pairs = lambda: {(r["key"], r["item"]) for r in decontaminate.leaks(docs, items).collect()}
    small = pairs()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    verbatim = connect(sf).execute("select d.doc_id, b.item_id from documents d, benchmark b where contains(d.text, b.text)").fetchall()
    assert pairs() == small >= set(verbatim)


# ---- 8: BPE


def test_bpe_is_that_of_the_library(spark, odd, none):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(odd.withColumn("ids", F.lit("clash")), path, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == known.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), path).collect()
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first()["decoded"]) == b""


def test_merges_wait_for_pairs_that_go_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 900, b"abc": 300, b"ab": 950, b"cd": 800, b"abcd": 301, b"xx": 310, b"xxx": 305}
    ranks = {k: v for v, k in enumerate(sorted(ranks, key=ranks.get))}
    import tiktoken

    known = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    words = [b"abcd", b"xxxx", b"xxxxx", b"abcabcd", b"a", b"zabcz" * 5]
    ids, off = bpe.Replay(ranks).encode(words)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [known.encode_ordinary(w.decode()) for w in words]


# ---- 9: WARC


def _records(spark, rows):
    full = [(i, u, None if d is None else f"2024-01-{d:02d} 00:00:00", t, s, h, None if b is None else b.encode()) for i, u, d, t, s, h, b in rows]
    frame = spark.createDataFrame(full, "record_id string, url string, date string, record_type string, status int, headers map<string,string>, body binary")
    return frame.select("record_id", "url", F.col("date").cast("timestamp").alias("warc_date"), "record_type", "status", "headers", "body", F.lit(1).alias("slice"))


def test_revisits(spark):
    full = lambda i, u, d, tag, body, **h: (i, u, d, "response", 200, {"etag": tag, "content-type": "t", "date": "old", **h}, body)
    again = lambda i, u, d, **h: (i, u, d, "revisit", 304, h or None, None)
    rows = [
        full("a", "http://www.X.com/p/", 1, "1", "one"), full("b", "https://x.com/p?utm_source=y", 3, "2", "two"), full("c", "http://x.com/p?b=1&a=2#f", 1, "3", "three", **{"last-modified": "L"}), ("err", "http://x.com/p", 4, "response", 500, None, "no"),
        again("r1", "http://x.com:80/p", 2, etag='W/1', date="new", server="s"), again("r2", "http://x.com/p", 5, etag="2"), again("r3", "http://x.com/p", 5, etag="1"), again("r4", "http://x.com/p", 1), again("r5", "http://x.com/p?a=2&b=1", 9, **{"last-modified": "L", "etag": "9"}),
        again("r6", "http://x.com/p?a=2&b=1", 9, **{"last-modified": "L"}), again("r7", None, 9), again("r8", "http://x.com/p", None), again("r9", "http://y.com/", 9), again("r2", "http://x.com/p", 5, etag="2"), full("a", "http://www.X.com/p/", 1, "1", "one"), again("0", "http://x.com/p", 1, etag="1"),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(_records(spark, rows)).collect()}
    outcome = {k: (r["outcome"], r["source_id"]) for k, r in got.items()}
    assert outcome == {"r1": ("resolved", "a"), "r2": ("resolved", "b"), "r3": ("mismatch", "b"), "r4": ("unverified", "a"), "r5": ("mismatch", "c"), "r6": ("resolved", "c"), "r7": ("unmatched", None), "r8": ("unmatched", None), "r9": ("unmatched", None), "0": ("unmatched", None)}
    assert got["r1"]["merged_headers"] == {"etag": "W/1", "content-type": "t", "date": "new"} and bytes(got["r1"]["body"]) == b"one" and got["r3"]["body"] is None
    assert warc.resolve_revisits(_records(spark, rows).limit(0)).count() == 0


def test_a_hot_url_over_slices_of_time(spark):
    rows = [(f"f{d:02d}", "http://h/", d, "response", 200, {"etag": str(d)}, str(d)) for d in range(1, 28, 5)] + [(f"v{d:02d}", "http://h/", d, "revisit", 304, {"etag": str((d - 2) // 5 * 5 + 1)}, None) for d in range(2, 29)]
    got = {r["record_id"]: (r["source_id"], r["outcome"]) for r in warc.resolve_revisits(_records(spark, rows), slices=7).collect()}
    assert got == {f"v{d:02d}": (f"f{(d - 1) // 5 * 5 + 1:02d}", "resolved" if (d - 1) % 5 else "mismatch") for d in range(2, 29)} | {f"v{d:02d}": (f"f{d:02d}", "mismatch") for d in range(6, 28, 5)}


def test_warc_files(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nETag: 1\r\nContent-Type: t\r\n\r\nbody\r\n\r\nmore"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Target-URI: http://x/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    both = record % (len(http), http) + record.replace(b"response", b"warcinfo") % (3, b"abc")
    (tmp_path / "a.warc").write_bytes(both)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(both[:400]) + gzip.compress(both[400:]))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {bytes(r["body"]) for r in got} == {b"body\r\n\r\nmore", b"abc"} and got[0]["headers"] == {"etag": "1", "content-type": "t"} and got[0]["status"] == 200


def test_broken_warc_files_are_told(spark, tmp_path):
    import gzip

    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\nContent-Length: %s\r\n\r\n"
    good = head % (b"a", b"3") + b"abc\r\n\r\n"
    (tmp_path / "length.warc").write_bytes(head % (b"x", b"many") + b"body\r\n\r\n" + good)
    (tmp_path / "short.warc").write_bytes(good + head % (b"y", b"99") + b"end")
    (tmp_path / "head.warc").write_bytes(good + b"WARC/1.0\r\nWARC-Type: resp")
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good * 50)[:-20])
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(good) + b"\x1f\x8bnonsense")
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "other.warc").write_bytes(b"no record at all")
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sum(r["error"] is None for r in got) >= 5 and all(bytes(r["body"]) == b"abc" for r in got if r["error"] is None)
    errors = sorted(r["error"] for r in got if r["error"])
    assert len(errors) == 5 and errors[-1].startswith("truncated") and any("many" in e for e in errors) and all(r["record_type"] == "broken" for r in got if r["error"])


# ---- 10: lines


WHITE = " \t\r\x0b\x0c"


def _kept_lines(rows: list[tuple[int, str | None]], least: int, words: int) -> dict[int, str | None]:
    seen: set = set()
    gone: dict[int, set[int]] = {}
    for k, t in sorted(rows):
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(WHITE)]
        for j in range(len(lines)):
            run = tuple(x for _, x in lines[j : j + least])
            one = (lines[j][1],)
            for own, n, counts in ((run, least, len(run) == least), (one, 1, least > 1 and len(one[0].split()) >= words)):
                if counts and (n, own) in seen:
                    gone.setdefault(k, set()).update(i for i, _ in lines[j : j + n])
                if counts:
                    seen.add((n, own))
    return {k: t if k not in gone else (lambda s: s if s.strip(WHITE + "\n") else "")("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])) for k, t in rows}


def _maximal_runs(rows: list[tuple[int, str | None]], least: int) -> dict[int, tuple[int, int]]:
    """The number and the greatest length of each text's maximal repeated runs, by holding all positions against all."""
    texts = {k: [x for x in (t or "").split("\n") if x.strip(WHITE)] for k, t in rows}
    places = [(k, i) for k, x in texts.items() for i in range(len(x))]

    def common(a, b):
        x, y = texts[a[0]][a[1] :], texts[b[0]][b[1] :]
        n = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        return n

    shared = {a: max((common(a, b) for b in places if a != b), default=0) for a in places}
    out = {}
    for k, x in texts.items():
        runs = [shared[k, i] for i in range(len(x)) if shared[k, i] >= least and (i == 0 or shared[k, i - 1] < least or i - 1 + shared[k, i - 1] < i + shared[k, i])]
        out[k] = (len(runs), max(runs, default=0))
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs_as_by_brute_force(spark, least):
    rng = np.random.default_rng(29)
    pool = [f"line {k} of words" for k in range(12)] + [" ".join(["long"] * 55), "", " ", "\r", "line 1 of words\r", "\t"]
    rows = [(k, "\n".join(rng.choice(pool, rng.integers(1, 25)))) for k in range(25)] + [(50, None), (51, ""), (52, "\n\n"), (53, "one\r\n\r\n\r\ntwo"), (54, "three\r\n\r\n\r\nfour")]
    rows += [(60, rows[3][1]), (61, rows[3][1] + "\nend"), (62, "start\n" + rows[3][1]), (63, "\n".join(["again"] * 9)), (64, "\n".join([f"own {k}" for k in range(19)])), (65, "\n".join([f"own {k}" for k in range(2, 18)]))]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=least, runs=True).collect()
    assert {r["doc_id"]: r["text"] for r in out} == _kept_lines(rows, least, line_dedup.MIN_WORDS)
    assert {r["doc_id"]: (r["n_runs"], r["longest_run"]) for r in out} == _maximal_runs(rows, least)


def test_string_keys(spark):
    rows = [("b", "x y\nz w\nlast"), ("a", "x y\nz w"), (None, "other"), ("a", "x y\nz w")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([("b", "last"), ("a", "x y\nz w"), ("a", "x y\nz w"), (None, "other")])
    base = _random_texts(2, 61, 60)
    docs = spark.createDataFrame([("y", base[0]), ("x", base[1] + base[0])], "doc_id string, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in suffix_dedup.remove_repeats(docs).collect()} == {"x": 0, "y": 1}


def test_line_dedup_on_odd_rows(spark, odd, none):
    got = line_dedup.dedup_lines(odd.withColumn("removed", F.lit("clash")))
    assert line_dedup.dedup_lines(odd.withColumn("__id", F.lit("c")).withColumn("__gone", F.lit("c")), runs=True).where("__id = 'c' and __gone = 'c'").count() == odd.count()
    assert got.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0 and got.columns[: len(odd.columns)] == odd.columns


# ---- the pipeline


def _near_groups(texts: dict[int, str | None]) -> dict[int, int]:
    """The least key that steps of similarity 0.8 or more of sets of five-word shingles lead to; texts without any word are alike."""
    sets = {}
    for k, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 5 * small >= 4 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda d: {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = corpus_pipeline.materialize(stages[0](spark, docs, sf), "test")
    assert set(texts(good)) == {r["key"] for r in quality.score(docs, labels).where("keep").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(bad & set(texts(good))) <= 0.05 * len(bad) and len(texts(good)) >= 0.6 * docs.count()
    lines = corpus_pipeline.materialize(stages[1](spark, good, sf), "test")
    assert texts(lines) == _kept_lines(list(texts(good).items()), line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
    alone = corpus_pipeline.materialize(stages[2](spark, lines, sf), "test")
    groups = _near_groups(texts(lines))
    assert set(texts(alone)) == {k for k, first in groups.items() if k == first}
    clean = corpus_pipeline.materialize(stages[3](spark, alone, sf), "test")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaking = {d for d, _ in _plain_leaks(texts(alone), items)}
    assert set(texts(clean)) == set(texts(alone)) - leaking
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    out = stages[4](spark, clean, sf).collect()
    assert {r["doc_id"]: r["text"] for r in out} == texts(clean) and all(r["ids"] == known.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["ids"]) for r in out)


def test_stages_on_odd_rows_and_on_none(spark, sf, odd, none):
    import corpus_pipeline

    for docs, n in ((odd, odd.count()), (none, 0)):
        docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("__id", F.lit("own"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.collect()
            assert out.columns[:5] == list(corpus_pipeline.COLUMNS)[:5] and len(rows) <= n, name
            if name in ("line dedup", "byte-level bpe", "benchmark decontamination"):
                assert len(rows) == n, name  # these lose no row of this fixture


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) < docs.count() and len({r["doc_id"] for r in out}) == len(out)
    assert all(r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"]) for r in out)
    leaked = {r[0] for r in connect(sf).execute("select d.doc_id from documents d, benchmark b where contains(d.text, b.text)").fetchall()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    assert not bad & {r["doc_id"] for r in out}
    texts = {r["doc_id"]: r["text"] for r in out}
    assert not any(b in t for t in texts.values() for b in (x[0] for x in connect(sf).execute("select text from benchmark").fetchall())) or not leaked

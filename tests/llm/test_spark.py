"""Corpus operators on small tables with nulls, repeats, empty and long texts, and clashing columns."""

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from ploidlens.llm import common, html, idfiles, jaccard, langid, licenses, mixing, packing, pii, quality, webp
from ploidlens.llm.queries import ORACLE_SQL, QUERIES

BASE = " ".join(f"w{k}" for k in range(80))
TEXTS = [None, "", "  \n", "a", "a b", "a b", BASE, BASE, BASE.replace("w40 ", "x "), BASE + " tail", "MIT License\nApache  License. Licensed under CC BY-NC 4.0.", "x@y.org 10.0.0.1 +1 (017) 555-7713", "é日本 \t" * 30, "long word " * 30_000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, size long, node string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    common.tune(spark)
    rows = [(k, t, ("en", "fr", None)[k % 3], ("b", None, "a")[k % 3], len(t or ""), "i", 1, 2, "n", "k") for k, t in enumerate(TEXTS)]
    rows += [rows[6], (None, BASE, "en", "a", 1, None, None, None, None, None)]
    return common.staged(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_equals_sql(spark, docs, tmp_path, name):
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    q = c.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, str(tmp_path)).select(*q.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, q.fetchall()))


def test_rows_are_kept(spark, docs):
    n = docs.count()
    tok = public_tokenizers.path("byte_bpe_50k.json")
    for df in (jaccard.jaccard_components(docs), pii.find_pii(docs), licenses.scan(docs), webp.read(webp.store(docs)), langid.identify(docs), quality.judged(docs), mixing.mix(docs), idfiles.read_ids(idfiles.write_ids(docs, tok))):
        assert df.count() == n
    assert mixing.mixed(docs).columns == docs.columns


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    tok = public_tokenizers.path("byte_bpe_50k.json")
    for df in (jaccard.jaccard_components(none), pii.find_pii(none), licenses.scan(none), webp.read(webp.store(none)), langid.identify(none), quality.judged(none), mixing.mix(none), idfiles.read_ids(idfiles.write_ids(none, tok)), packing.pack(none, tok), html.main_text(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert df.count() == 0


@pytest.mark.parametrize("num,heavy", [(80, 4096), (80, 3), (90, 4096), (90, 9)])
def test_jaccard_in_small_cells_equals_brute_force(spark, monkeypatch, num, heavy):
    monkeypatch.setattr(jaccard, "ROWS", 4)
    monkeypatch.setattr(jaccard, "LEAST", 2)
    monkeypatch.setattr(jaccard, "FEW", 10)
    monkeypatch.setattr(jaccard, "ENTRIES", 900)
    monkeypatch.setattr(jaccard, "SHARD", 1500)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    rng = np.random.default_rng(num)
    passage = [f"p{k}" for k in range(60)]  # that all texts share, so that they are one candidate block
    texts = []
    for _ in range(30):
        own = [f"x{k}" for k in rng.integers(0, 10**6, rng.integers(1, 300))]
        for _ in range(rng.integers(1, 5)):
            copy = list(own)
            for k in rng.integers(0, len(own), rng.integers(0, 1 + len(own) // 12)):
                copy[k] = f"y{rng.integers(0, 10**6)}"
            texts.append(" ".join(passage + copy[: len(copy) - rng.integers(0, 1 + len(copy) // 10)]))
    sets = [set(x.tolist()) for x in jaccard.shingle_sets(texts, 5)]
    comp, links = list(range(len(sets))), [0] * len(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                low, high = sorted((comp[i], comp[j]))
                comp = [low if c == high else c for c in comp]
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, num, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == [(k, len(sets[k]), comp[k], links[k]) for k in range(len(sets))]
    assert 0 < sum(links)


def test_packing_places_every_piece_once(spark, docs):
    p = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 64).toPandas()
    assert p.groupby("sequence_id").length.sum().max() <= 64
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
    assert p[p.doc_id == 13].length.sum() == 60_001


def test_id_files_starts(spark, docs):
    t = idfiles.read_ids(idfiles.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))).toPandas().sort_values("start")
    assert (t.start.to_numpy() == np.concatenate([[0], np.cumsum(t.n_tokens)[:-1]])).all()
    assert t.doc_id.dropna().is_monotonic_increasing


def test_components_of_many_near_copies(spark):
    rng = np.random.default_rng(0)
    words = [f"v{k}" for k in range(400)]
    rows = []
    for k in range(300):
        w = list(words[:120]) if k < 200 else [words[j] for j in rng.integers(0, 400, 60)]
        for _ in range(int(rng.integers(0, 3)) if k < 200 else 0):
            w[int(rng.integers(0, 120))] = f"x{rng.integers(0, 9)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for _, t in rows]
    link = [[i != j and 100 * len(a & b) >= 90 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([label[i], *(label[j] for j in range(len(rows)) if link[i][j])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    assert got == {i: (label[i], sum(link[i])) for i in range(len(rows))}


def test_pipeline_stages(spark, docs):
    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, at, ""), name)
        if name != "best_fit_packing":
            assert out.columns == at.columns
        if name == "near_duplicates":
            p = out.toPandas()
            assert not p.doc_id.dropna().duplicated().any() and set(p.doc_id.dropna()) <= set(at.toPandas().doc_id.dropna())
        if name == "personal_data":
            assert not any("@" in t for t in out.toPandas().text)
        at = out
    assert isinstance(at.toPandas(), pd.DataFrame)


def test_copies_do_not_narrow_the_band_of_a_language(spark):
    rng = np.random.default_rng(4)
    words = np.array(["".join(rng.choice(list("etaoinshrdlucm"), rng.integers(2, 9))) for _ in range(400)])
    text = lambda: " ".join(rng.choice(words, 300))
    one, two = text(), text()
    rows = [("a", text()) for _ in range(300)] + [("b", text()) for _ in range(40)] + [("b", one)] * 200
    rows += [(None, text()) for _ in range(20)] + [(None, two)] * 60
    df = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    lost = quality.judged(df).filter("not kept").select("row.lang", "row.text").collect()
    assert [(r["lang"], r["text"][:20]) for r in lost] == []


def test_rows_without_an_id_link_as_others(spark):
    w = [f"w{k}" for k in range(300)]
    near = lambda k: " ".join(w[:k] + ["x"] + w[k + 1 :])
    rows = [(1, " ".join(w)), (None, near(5)), (2, near(290)), (None, "one two three four"), (None, "one two three four"), (7, near(290)), (7, "an other text of seven"), (None, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.component_id, r.n_links) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == sorted([(1, 1, 3), (None, 1, 3), (2, 1, 3), (7, 1, 3), (7, 7, 0), (None, None, 1), (None, None, 1), (None, None, 0), (8, 8, 0)], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(df, 3, 90, 100).collect()), key=repr)
    assert kept == sorted([(1, " ".join(w)), (7, "an other text of seven"), (None, "one two three four"), (None, ""), (8, None)], key=repr)


def _plain_kneser_ney(texts, order):
    """Log probabilities of the n-grams of texts, by dictionaries and recursion."""
    from collections import Counter, defaultdict

    count = {order: Counter(p[k : k + order] for t in texts for p in [" " * (order - 1) + t + " "] for k in range(len(t) + 1))}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    after = {k: defaultdict(list) for k in count}
    for k, c in count.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)
    d = {k: [0, *quality.discounts(*[sum(n == j for n in c.values()) for j in (1, 2, 3, 4)])] for k, c in count.items()}

    def p(g):
        if not g:
            return 1 / len(count[1])
        k, n = len(g), count[len(g)][g]
        have = after[k][g[:-1]]
        take = lambda x: d[k][min(x, 3)]
        return (n - take(n) + sum(map(take, have)) * p(g[1:])) / sum(have)

    return {g: np.log(p(g)) for g in count[order]}


@pytest.mark.parametrize("small", [quality.SMALL, 0])
def test_perplexity_equals_plain_kneser_ney(spark, monkeypatch, small):
    monkeypatch.setattr(quality, "SMALL", small)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcde é日 "), rng.integers(1, 300))) for _ in range(40)] + ["а" * 30, "long " * 3000]
    p = _plain_kneser_ney(texts, quality.ORDER)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, None, ""])], "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["log_perplexity"] for r in quality.judged(df).select("row.doc_id", "log_perplexity").collect()}
    for k, t in enumerate(texts):
        x = " " * (quality.ORDER - 1) + t + " "
        assert abs(got[k] + np.mean([p[x[j : j + quality.ORDER]] for j in range(len(t) + 1)])) < 2e-6
    assert got[len(texts)] is None and got[len(texts) + 1] is None


def test_bands_are_exact_quartiles(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(words, 60)), ("a", "b", None)[k % 3]) for k in range(120)] + [(200, " ".join("qzxjk" for _ in range(3)) + " " + " ".join(f"q{k}zx" for k in range(80)), "a")]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).select("row.*", "log_perplexity", "band_low", "band_high", "base_failed", "kept").toPandas()
    for _, g in got.groupby(got.lang.fillna("-")):
        ok = g[~g.base_failed]
        x = np.sort(np.floor(ok.log_perplexity.to_numpy() * 1000))
        low, high = (x[-(-len(x) * k // 4) - 1] / 1000 for k in (1, 3))
        spread = max(high - low, quality.SPREAD)
        assert np.allclose(g.band_low, low - 3 * spread) and np.allclose(g.band_high, high + 3 * spread)
        assert (g.kept == (~g.base_failed & g.log_perplexity.between(low - 3 * spread, high + 3 * spread))).all()
    assert not got[got.doc_id == 200].kept.any()


def test_wrapped_notices_are_found(spark):
    import textwrap

    mit, bsd = (next(t for x, t in licenses.TEMPLATES if x == label and len(t) > size) for label, size in (("mit", 400), ("bsd", 100)))
    rows = [(k, "Some words\nbefore it.\n" + "\n".join(f"# {x}" for x in textwrap.wrap(t, width)) + "\n\nAnd after.") for k, (t, width) in enumerate((t, w) for t in (mit, bsd) for w in (40, 70, 80))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([*rows, (9, "Some words\nof no license")], "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "mit", 2: "mit", 3: "bsd", 4: "bsd", 5: "bsd", 9: ""}


@pytest.mark.parametrize("hub", [2, 10**6])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = np.random.default_rng(8)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(80)] + [tuple(x) for x in rng.integers(300, 420, (70, 2)).tolist()] + [(5, 5), (0, 3)]
    node = lambda k: (k * 7919 % 1009 - 500, k)
    df = spark.createDataFrame([(node(a), node(b)) for a, b in edges], common.EDGES.replace("u ", "u: ").replace(", v ", ", v: ")).repartition(5)
    label = {k: node(k) for e in edges for k in e if e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {tuple(r.node): tuple(r.comp) for r in common.components(df).collect()} == {node(k): c for k, c in label.items()}

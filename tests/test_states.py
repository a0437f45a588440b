"""States that add up, pieces of hot keys, replicates, statements, footers and facets against plain computations."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import rules as G
from fieldloom.functions import statements as T
from fieldloom.functions import vocabulary as V
from fieldloom.operators import catalog as C
from fieldloom.operators import facets as FA
from fieldloom.operators import increments as I
from fieldloom.operators import jobs as J
from fieldloom.operators import metrics as K
from fieldloom.operators import ordered as O
from fieldloom.operators import relational as R
from fieldloom.operators import resampling as S
from fieldloom.operators import sketches as H
from fieldloom.plans.rules import SPANNING
from fieldloom.plans.rules import P5
from fieldloom.sources import footers, readers


# Pieces of the order


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(O, "PIECE", 100)


def hot_rows(n=2000):
    """One key of nine tenths of the rows, a null key, ties, null scores."""
    rng = random.Random(3)
    return [("hot" if i % 10 else [None, "b", "c"][i // 10 % 3], None if i % 23 == 0 else float(rng.randrange(60)), i, i % 2) for i in range(n)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_of_a_hot_key(spark, small_pieces, descending):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, score double, tie long, v long").repartition(3)
    got = {r["tie"]: (r["rank"], r["total"]) for r in O.running(df, "score", {"rank": F.lit(1), "total": F.col("v")}, "tie", descending, ("k",)).collect()}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        sign = -1 if descending else 1
        mine.sort(key=lambda r: ((r[1] is None) == descending, sign * (r[1] or 0.0), r[2]))
        for rank, row in enumerate(mine, 1):
            assert got[row[2]] == (rank, sum(r[3] for r in mine[:rank]))


def test_no_piece_holds_a_hot_key(spark, small_pieces):
    df = spark.createDataFrame(hot_rows(), "k string, score double, tie long, v long")
    cut, pieces = O.in_pieces(df, [F.asc("k"), F.asc("score"), F.asc("tie")])
    assert pieces == 21 and cut.groupBy("_piece").count().agg(F.max("count")).first()[0] < 250


def test_auroc_and_precision_of_hot_strata(spark, small_pieces):
    rows = [r for r in hot_rows() if r[1] is not None]
    df = spark.createDataFrame([(k, s + t % 7 / 10, t, y) for k, s, t, y in rows], "k string, x double, t long, y long")
    got = {r["k"]: r["auroc"] for r in K.auroc(df, "x", "y", ("k",)).collect()}
    ap = {r["k"]: r["average_precision"] for r in K.average_precision(df, "x", "y", "t", ("k",)).collect()}
    for key in {r[0] for r in rows}:
        mine = [(s + t % 7 / 10, t, y) for k, s, t, y in rows if k == key]
        pos, neg = np.array([x for x, _, y in mine if y]), np.array([x for x, _, y in mine if not y])
        u = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / max(len(pos) * len(neg), 1)
        assert got[key] is None if not len(pos) * len(neg) else got[key] == pytest.approx(u, abs=1e-6)
        hits, found = 0, []
        for rank, (_, _, y) in enumerate(sorted(mine, key=lambda r: (-r[0], r[1])), 1):
            hits += y
            found += [hits / rank] * y
        assert ap[key] is None if not found else ap[key] == pytest.approx(np.mean(found), abs=1e-6)


def test_weighted_quantiles(spark, small_pieces):
    rng = random.Random(1)
    cells = [(k, float(v), rng.randrange(1, 50)) for k in ("a", None) for v in range(300)] + [("b", 5.0, 7), ("c", None, 3)]
    shares = {"p01": (1, 100), "p50": (1, 2), "p99": (99, 100), "all": (1, 1)}
    got = {r["k"]: r for r in O.weighted_quantiles(spark.createDataFrame(cells, "k string, v double, n long"), ["k"], "v", "n", shares).collect()}
    assert set(got) == {"a", None, "b"}
    for key in got:
        values = np.repeat([v for k, v, n in cells if k == key], [n for k, v, n in cells if k == key])
        for name, (a, b) in shares.items():
            assert got[key][name] == values[max(1, -(-len(values) * a // b)) - 1]


# Catalogues that grow


def observations(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.randrange(30), f"f{rng.randrange(4)}", i, None if rng.random() < 0.2 else float(rng.randrange(9)), rng.choice([None, "mg", "g"]), "t") for i in range(n)]
    return spark.createDataFrame(rows, C.OBSERVATION)


def test_incremental_catalogue(spark, tmp_path):
    folder, state = f"file://{tmp_path}/rows", f"file://{tmp_path}/state"
    parts = [observations(spark, i, 200).coalesce(2) for i in range(3)]
    counted = []
    for i, part in enumerate(parts):
        part.write.parquet(f"{folder}/{i}")
        counted.append(I.count_new_parts(spark, folder, state, lambda df: df))
    assert counted == [2, 2, 2] and I.count_new_parts(spark, folder, state, lambda df: df) == 0
    # Cells of a batch that was not finished are not read.
    C.field_cells(parts[0]).write.parquet(f"{state}/cells/batch=9")
    whole = C.field_catalog(parts[0].union(parts[1]).union(parts[2]))
    order = sorted(whole.columns)
    got, want = (sorted(map(tuple, x.select(*order).collect()), key=repr) for x in (I.catalog_so_far(spark, state), whole))
    assert got == want and len(got) == 4
    parts[1].write.mode("overwrite").parquet(f"{folder}/0")
    counted_again = I.part_files(spark, folder).join(I.counted_files(spark, state), "path", "left_anti").count()
    assert counted_again > 0 and I.count_new_parts(spark, folder, state, lambda df: df) == counted_again


def test_changed_part_is_an_error(spark, tmp_path):
    folder, state = f"file://{tmp_path}/rows", f"file://{tmp_path}/state"
    observations(spark, 1, 50).coalesce(1).write.parquet(folder)
    I.count_new_parts(spark, folder, state, lambda df: df)
    [old] = [p for p in (tmp_path / "rows").glob("*.parquet")]
    observations(spark, 2, 90).coalesce(1).write.parquet(f"file://{tmp_path}/other")
    [new] = [p for p in (tmp_path / "other").glob("*.parquet")]
    old.with_name(f".{old.name}.crc").unlink(missing_ok=True)
    old.write_bytes(new.read_bytes())
    with pytest.raises(ValueError, match="has changed"):
        I.count_new_parts(spark, folder, state, lambda df: df)


def test_catalogue_reads_its_rows_once(spark, tmp_path):
    """All figures come out of the stored cells: no plan behind the catalogue reads the observations."""
    path = f"file://{tmp_path}/observations"
    observations(spark, 1, 50).write.parquet(path)
    plan = C.field_catalog(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Expand" not in plan and "t_offset" not in plan


def test_catalogue_of_few_and_of_many_rows(spark, monkeypatch):
    rows = observations(spark, 7, 400).union(observations(spark, 8, 60).withColumn("field_key", F.lit(None).cast("string")))
    rows = rows.unionByName(observations(spark, 9, 9).withColumns({"field_key": F.lit("rare"), "value_num": F.lit(None).cast("double"), "value_uom": F.lit(None).cast("string")}))
    rows = rows.unionByName(observations(spark, 9, 9).withColumn("src_table", F.lit("other")))
    found = C.field_catalog(rows)
    order = sorted(found.columns)
    want = sorted(map(tuple, C.catalog_of(C.field_cells(rows)).select(*order).collect()), key=repr)
    for piece in (1_000_000, 70, 1):
        monkeypatch.setattr(O, "PIECE", piece)
        assert sorted(map(tuple, C.field_catalog(rows).select(*order).collect()), key=repr) == want
    assert len(want) == 10


def test_catalogue_sends_the_rows_of_a_field_once(spark):
    """Fields of few rows are no cells of stays, values and units, and are not sorted again in pieces."""
    found = C.field_catalog(observations(spark, 1, 50))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1 and "_piece" not in plan and "kind#" not in plan


def test_sketches_merge(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).cast("string").alias("k"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("e"), F.col("id").cast("double").alias("v"), (F.col("id") % 5).alias("part"))
    rows = rows.withColumn("v", F.when(F.col("k") != "2", F.col("v")))
    told = H.estimates(H.merged(H.part_sketches(rows, ["k", "part"], "e", "v"), ["k"]), ["k"])
    got = {r["k"]: r for r in H.kept_bounds(told, rows, ["k"], "e", "v", {"p01": 0.01, "p50": 0.5, "p99": 0.99}).collect()}
    assert all(r["count_kept"] and r["rank_kept"] for r in got.values())
    assert got["2"]["n_numeric"] == 0 and got["0"]["n"] == 13334
    wrong = told.withColumns({"n_entities": F.col("n_entities") * 2, "p50": F.col("p50") * 1.2})
    bad = H.kept_bounds(wrong, rows, ["k"], "e", "v", {"p50": 0.5}).filter("k <> '2'").collect()
    assert not any(r["count_kept"] or r["rank_kept"] for r in bad)


# Replicates


def test_binomial_against_sums():
    rng = np.random.default_rng(0)
    for m, p in ((1, 0.5), (7, 0.1), (300, 0.37), (5000, 0.002), (20_000, 0.5)):
        u = rng.random(50)
        k = np.arange(m + 1)
        log = np.array([math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) for i in k]) + k * math.log(p) + (m - k) * math.log1p(-p)
        want = np.searchsorted(np.cumsum(np.exp(log)), u)
        whole = 1_000_000
        got = S.binomial(np.full(50, m), np.full(50, round(p * whole)), np.full(50, whole), u)
        assert (got == np.minimum(want, m)).all()


@pytest.mark.parametrize("block", [1024, 4])
def test_replicates_are_multinomial(spark, monkeypatch, block):
    """Totals, means and variances of the counts; the same again on a rerun; blocks of cells alike."""
    monkeypatch.setattr(S, "BLOCK", block)
    weights = [1, 40, 0, 7, 3, 200, 9, 9, 1, 30]
    rows = spark.createDataFrame([(i, i % 2) for i, n in enumerate(weights) for _ in range(n)], "x long, y long").repartition(3)
    found = S.replicates(rows, ["x", "y"], 1500)
    got = {(r["rep"], r["x"]): r["weight"] for r in found.collect()}
    assert got == {(r["rep"], r["x"]): r["weight"] for r in S.replicates(rows.repartition(2), ["x", "y"], 1500).collect()}
    n, table = sum(weights), np.zeros((1500, len(weights)))
    for (rep, x), w in got.items():
        table[rep, x] = w
    assert (table.sum(axis=1) == n).all()
    p = np.array(weights) / n
    assert np.allclose(table.mean(axis=0), n * p, atol=4 * np.sqrt(n * p * (1 - p) / 1500) + 1e-9)
    assert np.allclose(table.var(axis=0), n * p * (1 - p), rtol=0.2, atol=0.2)
    assert np.corrcoef(table[:, 1], table[:, 5])[0, 1] < -0.25
    assert S.replicates(rows.limit(0), ["x", "y"], 3).isEmpty()


# Statements


def spanning(text):
    """Triples by patterns over both ends."""
    out = set()
    for name, pattern, one, many, ids, concept, body in [*SPANNING, ("P5", P5, "", None, "", 4, 3)]:
        for m in re.finditer(pattern, text, re.ASCII):
            if body and len(m.group(body)) > 900:
                continue
            if name == "P5":
                keys = [f"{m.group(1)}|{m.group(2)}"]
            else:
                only = m.group(int(one)) if one else None
                keys = [only] if only else re.findall(ids, (m.group(int(many)) if many else "") or "")
            out |= {(name, k, m.group(concept).strip()) for k in keys}
    return out


PIECES = [
    "CASE WHEN itemid = 5", "case when itemid in (1, 22)", "CASE  WHEN itemid IN (", "END AS foo", "end ) as bar_1", "END", " END\t)  AS x", "then 1 -- Name (a, b\n", "\n",
    "when itemid in (7)", "when itemid = 9 then 'L x'", "case when labname = 'q'", "case when labname in ('a', 'b')", "respchartvaluelabel = 'r'", "respchartvaluelabel in ('s', 't')",
    "nursingchartcelltypevallabel = 'u' and nursingchartcelltypevalname = 'v'", " and x > 0 ", "y" * 500, ")", "(", " ", ", ", "WEEKEND AS w",
]


def test_statements_against_spanning_patterns(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([("x", f"{i}", t) for i, t in enumerate(texts)] + [("x", "null", None)], "db string, file string, text string")
    got = {}
    for r in T.triples(df, "db", "text", "file").collect():
        got.setdefault(r["src_file"], set()).add((r["pattern"], r["field_key"], r["concept_raw"]))
    for i, t in enumerate(texts):
        # Where brackets are open, a list may run over lines that end without a name.
        lines = {"P2"} if t.count("(") != t.count(")") else set()
        assert {x for x in got.get(str(i), set()) if x[0] not in lines} == {x for x in spanning(t) if x[0] not in lines}, t
    assert "null" not in got


def test_statements_are_linear(spark):
    """Beginnings without an end, brackets and quotes that none closes, long blanks."""
    n = 10_000
    texts = ["CASE WHEN itemid = 1 THEN " * n, "CASE WHEN itemid IN (" * n, "when itemid in (1) " * n, "case when labname in ('a') " * n, "END" + " " * (20 * n), "respchartvaluelabel = 'a' " * n]
    texts.append("CASE WHEN itemid = 1 THEN v END AS x, " * n)
    df = spark.createDataFrame([("x", str(i), t) for i, t in enumerate(texts)], "db string, file string, text string")
    began = time.time()
    counts = {r["src_file"]: r["count"] for r in T.triples(df, "db", "text", "file").groupBy("src_file").count().collect()}
    assert counts == {"6": n} and time.time() - began < 60


# Profiles, samples, parity


def test_profiles_of_edges(spark):
    rows = [("a", "1.5", 1), ("a", "x", 1), (None, "2", 2), ("", None, None), ("a", "3", 3)]
    df = spark.createDataFrame(rows, "k string, v string, e long")
    jobs = [J.Job("all", ("k",), "v", "e"), J.Job("some", ("k", "e"), "v", "e", "k = 'a'", 2), J.Job("none", ("k",), "v", "e", "false")]
    got = {(r["job"], tuple(r["keys"])): (r["n"], r["n_entities"], r["n_numeric"], r["n_other"], r["p50"]) for r in J.profiles(df, jobs).collect()}
    assert got == {
        ("all", ("a",)): (3, 2, 2, 1, 1.5), ("all", (None,)): (1, 1, 1, 0, 2.0), ("all", ("",)): (1, 0, 0, 1, None),
        ("some", ("a", "1")): (2, 1, 1, 1, 1.5), ("some", ("a", "3")): (1, 1, 1, 0, 3.0),
    }
    assert J.profiles(df.limit(0), jobs).isEmpty()


def test_sample_bounds_its_shuffle(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("s"))
    got = R.stratified_sample(df, "s", "id", {"hot": 7, "rare": 3}, "x")
    assert {r["s"]: r["count"] for r in got.groupBy("s").count().collect()} == {"hot": 7, "rare": 3}
    # A partial limit stands below the exchange.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_records_of_split_files(spark, tmp_path):
    """Quoted breaks, quotes, blank lines and commas, in files that are read in many blocks."""
    import csv

    rng, want = random.Random(2), {}
    for name, n in (("a", 3000), ("b", 0), ("c", 1)):
        with (tmp_path / f"{name}.csv").open("w", newline="") as f:
            w = csv.writer(f, lineterminator="\n")
            w.writerow(["id", 'the "name",\nin two lines', "z"])
            for i in range(n):
                w.writerow([i, rng.choice(["plain", 'a "b"', "x\ny", "\n\n", "", 'c,"\n"d']), rng.choice(["", "q"])])
        want[name] = (n, 3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r["file"].rsplit("/", 1)[1][0]: (r["rows"], r["cols"]) for r in readers.csv_inventory(spark, f"file://{tmp_path}").collect()}
        names = {r["column_name"] for r in readers.headers(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and names == {"id", 'the "name",\nin two lines', "z"}


def test_footers_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a long, b string").write.parquet(path)
    assert tuple(footers.parquet_counts(spark, path, ["a", "b"]).first()) == (3, 2, 1)
    assert footers.reads_footers_only(spark, path, ["a", "b"])
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


# Facets and losses


def cube(rng, n, slices=4, width=5):
    return rng.normal(size=(n, slices, width))


def test_facets_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    f, c = cube(rng, 40), cube(rng, 90)
    f[3], c[7], c[8] = 0.0, 0.0, c[9]
    fields = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f)], "field_key long, slices array<array<double>>")
    concepts = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "concept long, slices array<array<double>>")
    unit = lambda x: x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-9)
    score = np.round(np.einsum("nkd,ckd->nc", unit(f), unit(c)), 6)
    want = {i: sorted(range(90), key=lambda j: (-score[i, j], j))[:6] for i in range(40)}
    for chunk in (1 << 22, 200):
        got = {}
        for r in FA.facet_topk(fields, concepts, 6, chunk).orderBy("field_key", "rank").collect():
            got.setdefault(r["field_key"], []).append(r["concept"])
        assert got == want
    assert FA.facet_topk(fields, concepts.limit(0), 6).isEmpty()
    assert FA.facet_topk(fields.limit(0), concepts, 6).isEmpty()
    with pytest.raises(Exception, match="slices"):
        FA.facet_topk(fields, spark.createDataFrame([(1, [[1.0, 2.0]])], concepts.schema), 2).collect()


def test_many_concepts_meet_fields_without_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    f, c = cube(rng, 30), np.repeat(cube(rng, 9), 20, axis=0)
    fields = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(f)], "field_key long, slices array<array<double>>")
    concepts = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "concept long, slices array<array<double>>")
    order = ["field_key", "rank"]
    want = FA.facet_topk(fields, concepts, 6).orderBy(order).collect()
    monkeypatch.setattr(type(fields), "toArrow", None)  # no block is collected
    for chunk in (2000, 100):
        found = FA.facet_topk(fields, concepts, 6, chunk)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow" not in plan and "Union" not in plan
        assert found.orderBy(order).collect() == want


def test_concepts_that_are_alike_are_sent_k_times_at_most():
    rng = np.random.default_rng(6)
    keys, c = pa.array(range(3)), np.repeat(cube(rng, 2), 50, axis=0)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    [got] = FA._best(keys, unit(cube(rng, 3)), np.arange(100), unit(c), 4)
    assert got.num_rows == 12
    for i in range(3):
        names = [r["concept"] for r in got.to_pylist() if r["field_key"] == i]
        assert names in ([0, 1, 2, 3], [50, 51, 52, 53])


def test_diversity(spark):
    k, d = 6, 32
    eye, same = np.eye(k, d), np.repeat(np.random.default_rng(0).normal(size=(1, d)), k, axis=0)
    rows = [(0, eye.tolist()), (0, eye.tolist()), (1, same.tolist()), (2, np.zeros((k, d)).tolist())]
    got = {r["batch"]: r["loss"] for r in FA.diversity_loss(spark.createDataFrame(rows, "batch long, slices array<array<double>>")).collect()}
    assert got[0] == pytest.approx(0.0, abs=1e-6) and got[1] > 0.05 and got[2] == 0.0
    assert got[1] == pytest.approx(math.sqrt(k * (k - 1)) / k**2)


@pytest.mark.parametrize("rows", [256, 3])
def test_losses_against_whole_matrices(spark, monkeypatch, rows):
    monkeypatch.setattr(FA, "ROWS", rows)
    rng = np.random.default_rng(6)
    n, d, classes = 11, 8, 4
    a, b, label = 5 * rng.normal(size=(n, d)), rng.normal(size=(n, d)), rng.integers(0, classes, n)
    w = rng.normal(size=(classes, d))
    pairs = spark.createDataFrame([(1, i, int(label[i]), a[i].tolist(), b[i].tolist()) for i in range(n)], "batch long, id long, label long, a array<double>, b array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    same = (label[:, None] == label).astype(float)
    mask = np.log(same / np.linalg.norm(same, axis=1, keepdims=True) + 1e-8)

    def log_softmax(x):
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    want = sum((np.exp(log_softmax(x)) * (log_softmax(x) - mask)).sum(axis=1).mean() for x in (a @ unit(b).T, b @ unit(a).T))
    cosine = unit(a) @ unit(b).T
    got = FA.matching_loss(pairs).first()
    assert got["n"] == n and got["loss"] == pytest.approx(want)
    assert got["positive"] == pytest.approx(cosine[same == 1].mean()) and got["negative"] == pytest.approx(cosine[same == 0].mean())
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "label long, vector array<double>")
    found = FA.classification_loss(pairs, table).first()
    logits = [((x * unit(y)).sum(axis=1, keepdims=True) * unit(y)) @ unit(w).T for x, y in ((a, b), (b, a))]
    assert found["loss"] == pytest.approx(sum(-log_softmax(x)[np.arange(n), label].mean() for x in logits))
    assert (found["right_a"], found["right_b"]) == pytest.approx(tuple((x.argmax(axis=1) == label).mean() for x in logits))


# Reasons


def test_every_rule_has_its_reason(spark):
    shape = ", ".join(f"{s}raw_name string, {s}src_table string, {s}unit_observed string, {s}dtype_inferred string, {s}dtype_declared boolean, {s}specimen string" for s in ("a_", "b_"))
    nurse = next(t for t in V.TABLE_FAMILIES if t.lower().endswith("nursecharting"))
    row = ("Temperature (C)", nurse, None, "numeric", None, None, "Temperature (F)", nurse, None, "numeric", None, None)
    a, b = G.Field.at("a_"), G.Field.at("b_")
    said = spark.createDataFrame([row], shape).select(G.explain(G.gate(a, b), a, b).alias("x")).first()["x"]
    for word in ("v_unit", "v_type", "v_prov", "unit: degC (from_name) / degF (from_name) convertible", "type: numeric / numeric compatible", "provenance: families", "specimen: - / - cannot tell", "kept"):
        assert word in said
    assert len(said.splitlines()) >= 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(0, 400))
def test_splits_keep_their_sum(weights, m):
    table = np.zeros((1, 16), np.int64)
    table[0, : len(weights)] = weights
    counts = S.split(np.array([3]), np.array([0]), np.array([m]), table)[0]
    assert counts.sum() == m and (counts[len(weights) :] == 0).all() and (counts >= 0).all()

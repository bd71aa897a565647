"""Block-wise numbering against plain Python, with one document holding a third of the rows."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from docloom.operators import layout, ordering, segment
from docloom.operators.assemble import assemble_parts


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for doc in range(12):
        n = 400 if doc == 3 else rnd.choice([0, 1, 2, 5, 9, 60])
        positions = rnd.sample(range(-50, 1500), n)
        out += [(doc, p, rnd.choice(["a", "b", None])) for p in positions]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, pos long, kind string").repartition(5)


def by_doc(rows):
    for doc, part in groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        yield doc, list(part)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_running_sums(df, rows, block):
    got = {(r.id, r.pos): (r.s, r.t) for r in ordering.running_sums(
        df, "id", "pos", {"s": F.when(F.col("kind") == "a", 2).otherwise(1)}, {"t": "s"}, block).collect()}
    want = {}
    for doc, part in by_doc(rows):
        weights = [2 if k == "a" else 1 for _, _, k in part]
        for i, (_, pos, _) in enumerate(part):
            want[doc, pos] = (sum(weights[: i + 1]), sum(weights))
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_number_rows(df, rows, block):
    got = {(r.id, r.pos): (r.n, r.t) for r in ordering.number_rows(df, "id", "pos", "n", "t", block).collect()}
    want = {(d, p[1]): (i, len(part)) for d, part in by_doc(rows) for i, p in enumerate(part)}
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 1024])
@pytest.mark.parametrize("count_null", [True, False])
def test_number_islands(df, rows, block, count_null):
    got = {(r.id, r.pos): r.n for r in ordering.number_islands(
        df, "id", "pos", "kind", "n", count_null, block).collect()}
    want = {}
    for doc, part in by_doc(rows):
        n = 0
        for kind, run in groupby(part, key=lambda r: r[2]):
            n += 1 if count_null or kind is not None else 0
            for r in run:
                want[doc, r[1]] = n
    assert got == want


def test_with_extremes(df, rows):
    got = {(r.id, r.pos): (r.lo, r.hi) for r in ordering.with_extremes(
        df, "id", "pos", {"lo": F.when(F.col("kind") == "a", F.col("pos"))}, {"hi": F.col("pos")}, 7).collect()}
    want = {}
    for doc, part in by_doc(rows):
        marked = [p for _, p, k in part if k == "a"]
        for _, p, _ in part:
            want[doc, p] = (min(marked) if marked else None, part[-1][1])
    assert got == want


@pytest.mark.parametrize("kind", ["int", "long"])
def test_order_values_far_apart(spark, rows, kind):
    """Positions times a million: every block has one row, and so have most blocks of blocks."""
    step = 1_000_000 if kind == "long" else 900_000
    far = [(d, p * step, k) for d, p, k in rows]
    df = spark.createDataFrame(far, f"id long, pos {kind}, kind string").repartition(5)
    sums = {(r.id, r.pos): (r.s, r.t) for r in ordering.running_sums(
        df, "id", "pos", {"s": F.when(F.col("kind") == "a", 2).otherwise(1)}, {"t": "s"}).collect()}
    islands = {(r.id, r.pos): r.n for r in ordering.number_islands(df, "id", "pos", "kind", "n", False).collect()}
    ends = {(r.id, r.pos): (r.lo, r.hi) for r in ordering.with_extremes(
        df, "id", "pos", {"lo": F.col("pos")}, {"hi": F.col("pos")}).collect()}
    assert len(sums) == len(islands) == len(ends) == len(far)
    for d, part in by_doc(far):
        total, n, last = 0, 0, None
        for _, pos, k in part:
            total += 2 if k == "a" else 1
            n += k is not None and k != last
            last = k
            assert sums[d, pos][0] == total and islands[d, pos] == n and ends[d, pos] == (part[0][1], part[-1][1])
        assert all(sums[d, pos][1] == total for _, pos, _ in part)


def test_no_window_holds_a_document(spark):
    """A third of all rows in one document, a second apart in microseconds: the most rows that a
    window of blocks can hold is what lies in FAN neighbouring blocks."""
    df = spark.range(30000).selectExpr("if(id % 3 = 0, -7, id) AS doc", "id * 1000000 AS at")
    blocked = ordering.with_block(df, "at")
    assert blocked.groupBy("doc", "__blk").count().agg(F.max("count")).first()[0] <= ordering.BLOCK
    ups = blocked.select("doc", F.floor(F.col("__blk") / ordering.FAN).alias("up")).groupBy("doc", "up").count()
    assert ups.agg(F.max("count")).first()[0] < 1000
    got = ordering.number_rows(df, "doc", "at", "n", "t").where("doc = -7").agg(F.max("n"), F.min("t"), F.count("*")).first()
    assert tuple(got) == (9999, 10000, 10000)


@pytest.mark.parametrize("dense", [False, True])
def test_chunk_counts(spark, dense):
    """ceil(n / 3) chunks, nothing lost, order kept; one document crosses many blocks."""
    sizes = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 9: 9, 10: 10, 20: 20, 7: 2000}
    rows = [(d, i, f"<p>{d}.{i}</p>") for d, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "doc_id long, page_no long, html string")
    got = segment.chunk_pages(pages, dense=dense).collect()
    for d, n in sizes.items():
        chunks = sorted((r for r in got if r.doc_id == d), key=lambda r: r.chunk_index)
        assert [c.chunk_index for c in chunks] == list(range(-(-n // 3)))
        assert {c.chunk_total for c in chunks} == {-(-n // 3)}
        assert [p for c in chunks for p in c.pages] == [f"<p>{d}.{i}</p>" for i in range(n)]
    assert segment.chunk_pages(pages.where("doc_id < 0"), dense=dense).count() == 0


def test_chunk_pages_with_gaps(spark):
    pages = spark.createDataFrame([(1, p, str(p)) for p in (5, 9000, 70, 2, 41)], "doc_id long, page_no long, html string")
    got = segment.chunk_pages(pages).orderBy("chunk_index").collect()
    assert [r.pages for r in got] == [["2", "5", "41"], ["70", "9000"]]


def test_parts_join_to_the_document(spark):
    rows = [(d, i, n, f"[{d}.{i}]") for d, n in ((1, 1), (2, 10), (3, 57)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index long, chunk_total long, html string")
    got = assemble_parts(df, "doc_id", per_part=10, header="<", footer=">").collect()
    for d, n in ((1, 1), (2, 10), (3, 57)):
        parts = sorted((r for r in got if r.doc_id == d), key=lambda r: r.part_no)
        assert len(parts) == -(-n // 10) == parts[0].part_total
        assert "".join(p.html for p in parts) == "<" + "".join(f"[{d}.{i}]" for i in range(n)) + ">"


def test_page_break_on_first_block(spark):
    df = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True)], "id long, pos long, b boolean")
    got = layout.assign_pages(df, "id", "pos", F.col("b")).orderBy("pos").collect()
    assert [r.page_no for r in got] == [2, 2, 3]


def test_cell_spans_in_a_long_table(spark):
    """A merged run over several blocks of rows, next to single cells."""
    n = 3000
    rows = [(1, r, 0, "tall", 1) for r in range(n)] + [(1, r, 1, f"c{r}", 1) for r in range(n)]
    rows += [(2, 0, 0, "wide", 2), (2, 0, 1, "wide", 1), (2, 1, 0, "wide", 2), (2, 1, 1, "wide", 1), (2, 2, 0, "x", 1)]
    df = spark.createDataFrame(rows, "t long, row_no long, col_no long, cell_id string, grid_span int")
    got = {(r.t, r.row_no, r.col_no): (r.colspan, r.rowspan) for r in layout.cell_spans(df, ["t"]).collect()}
    assert got[1, 0, 0] == (1, n) and len([k for k in got if k[0] == 1]) == n + 1
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 0, 0): (2, 2), (2, 2, 0): (1, 1)}

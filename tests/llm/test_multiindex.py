import random

from tierflow.llm import multiindex as M


def brute(rows, k):
    codes = {i: [x is not None and x > 0 for x in v] for i, v in rows if v is not None and len(v) == len(rows[0][1])}
    out = []
    for q in codes:
        if q % 10 == 0:
            near = sorted((sum(a != b for a, b in zip(codes[q], c)), i) for i, c in codes.items() if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_matches_brute_force(spark):
    pick = random.Random(7)
    centres = [[pick.gauss(0, 1) for _ in range(20)] for _ in range(5)]
    rows = [(k, [x + pick.gauss(0, 0.6) for x in pick.choice(centres)]) for k in range(200)]
    rows += [(1000 + k, rows[0][1]) for k in range(30)] + [(2000, None), (2010, []), (2020, [1.0]), (2030, [None] * 20)]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, code int")
    for k, width in ((3, 7), (12, None)):
        got = sorted(tuple(r) for r in M.nearest_codes(vectors, k, "id % 10 = 0", width=width).collect())
        assert got == brute(rows, k)


def test_few_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in M.nearest_codes(vectors, 5, "id % 10 = 0").collect()] == [(0, 1, 1, 1)]
    assert M.nearest_codes(vectors.limit(0), 5, "true").count() == 0


def test_repeated_rows_and_lengths(spark):
    """Rows of one id are one; vectors of another length are searched among themselves."""
    rows = [(0, [1.0, 1.0, 1.0])] * 12 + [(1, [1.0, 1.0, -1.0]), (2, [1.0, -1.0, -1.0]), (3, [-1.0, -1.0, -1.0])]
    rows += [(10, [1.0, 1.0]), (11, [-1.0, 1.0]), (11, [1.0, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in M.nearest_codes(vectors, 2, "id % 10 = 0").collect())
    assert got == [(0, 1, 1, 1), (0, 2, 2, 2), (10, 1, 11, 1)]


def test_common_vector_and_clashing_columns(spark):
    """A vector of a third of the rows; other columns with the names that the search uses."""
    pick = random.Random(3)
    rows = [(k, [1.0] * 16 if k % 3 == 0 else [pick.gauss(0, 1) for _ in range(16)]) for k in range(900)]
    vectors = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, id int, q int, chunk int")
    got = sorted(tuple(r) for r in M.nearest_codes(vectors, 4, "id % 10 = 0").collect())
    assert got == brute(rows, 4)

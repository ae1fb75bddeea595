import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roentgrid.functions import boxes as bx

BOXES = "a array<array<double>>, b array<array<double>>"


def area(boxes):
    """Covered area by cells between all edges."""
    xs = sorted({v for b in boxes for v in (b[0], b[2])})
    ys = sorted({v for b in boxes for v in (b[1], b[3])})
    total = 0.0
    for x1, x2 in zip(xs, xs[1:]):
        for y1, y2 in zip(ys, ys[1:]):
            if any(b[0] <= x1 and b[2] >= x2 and b[1] <= y1 and b[3] >= y2 for b in boxes):
                total += (x2 - x1) * (y2 - y1)
    return total


def iou(a, b):
    a = [x for x in a if x[0] < x[2] and x[1] < x[3]]
    b = [x for x in b if x[0] < x[2] and x[1] < x[3]]
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    u = area(a + b)
    return (area(a) + area(b) - u) / u


def score(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + BOXES)
    return [r["v"] for r in df.select("i", bx.union_iou("a", "b").alias("v")).orderBy("i").collect()]


def test_union_iou_cases(spark):
    unit, half = [0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 0.5, 1.0]
    rows = [
        ([], []),
        ([unit], []),
        ([], [unit]),
        ([unit], [unit]),
        ([unit], [half]),
        ([half, [0.5, 0.0, 1.0, 1.0]], [unit]),
        ([[0.2, 0.2, 0.2, 0.4]], []),
        ([half], [[0.5, 0.0, 1.0, 1.0]]),
        ([unit, half], [half, half]),
    ]
    assert score(spark, rows) == pytest.approx([1, 0, 0, 1, 0.5, 1, 1, 0, 0.5])


def test_union_iou_brute_force(spark):
    rng = random.Random(3)

    def some():
        return [[round(rng.random(), 1) for _ in range(4)] for _ in range(rng.randint(0, 6))]

    rows = [(some(), some()) for _ in range(300)]
    got = score(spark, rows)
    assert got == pytest.approx([iou(a, b) for a, b in rows], abs=1e-9)
    assert got == pytest.approx(score(spark, [(b, a) for a, b in rows]), abs=1e-9)
    assert all(0 <= v <= 1 for v in got)


coordinate = st.integers(0, 20).map(lambda v: v / 20)
box = st.tuples(coordinate, coordinate, coordinate, coordinate).map(list)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.lists(box, max_size=5), st.lists(box, max_size=5)), min_size=1, max_size=20))
def test_union_iou_property(spark, rows):
    assert score(spark, rows) == pytest.approx([iou(a, b) for a, b in rows], abs=1e-9)


def test_conversions(one):
    assert one(bx.xyxy_to_cxcywh("b"), b=[0.0, 0.0, 0.5, 1.0]) == [0.25, 0.5, 0.5, 1.0]
    assert one(bx.cxcywh_to_xyxy("b"), b=[0.25, 0.5, 0.5, 1.0]) == [0.0, 0.0, 0.5, 1.0]
    assert one(bx.to_xyxy("b", "coco"), b=[0.1, 0.2, 0.3, 0.4]) == pytest.approx([0.1, 0.2, 0.4, 0.6])
    assert one(bx.to_xyxy("b", "pascal_voc", F.lit(10), F.lit(20)), b=[1.0, 2.0, 5.0, 10.0]) == [0.1, 0.1, 0.5, 0.5]
    with pytest.raises(ValueError):
        bx.to_xyxy("b", "polar")


def test_clamps_differ(one):
    assert one(bx.clamp_box("b"), b=[-0.1, 0.2, 1.5, 0.4]) == [0.0, 0.2, 1.0, 0.4]
    assert one(bx.clamp_box("b"), b=[1.2, 0.2, 1.5, 0.4]) is None
    # Raising only the minima leaves a box right of the image invalid, clamping all sides too.
    assert one(bx.norm_xyxy("b", F.lit(10), F.lit(10)), b=[-5.0, 1.0, 20.0, 4.0]) == [0.0, 0.1, 1.0, 0.4]
    assert one(bx.norm_xyxy("b", F.lit(0), F.lit(10)), b=[1.0, 1.0, 2.0, 2.0]) is None
    assert one(bx.norm_xyxy("b", F.lit(10), F.lit(10)), b=[3.0, 1.0, 3.0, 4.0]) is None


def test_norm_xywh(one):
    args = [F.lit(v) for v in (1.0, 2.0, 3.0, 4.0)]
    assert one(bx.norm_xywh(*args, F.lit(10), F.lit(20))) == pytest.approx([0.1, 0.1, 0.4, 0.3])
    assert one(bx.norm_xywh(*args, F.lit(0), F.lit(20))) is None
    with pytest.raises(PySparkException):
        one(bx.norm_xywh(*args, F.lit(0), F.lit(20), strict=True))


def test_format_like_printf(one, spark):
    rng = random.Random(1)
    values = [0.125, 2.675, 1.005, 0.5, 0.0, 1.0, 0.995] + [rng.random() for _ in range(200)] + [i / 256 for i in range(257)]
    df = spark.createDataFrame([([v] * 4,) for v in values], "b array<double>")
    got = [r["v"] for r in df.select(bx.format_box("b").alias("v")).collect()]
    assert got == ["[" + ",".join([f"{v:.2f}"] * 4) + "]" for v in values]


def test_parse(one):
    assert one(bx.parse_boxes("t"), t="a [0.1, 2 ,-3.5,4.] b[1,2,3] [1,2,3,4]") == [[0.1, 2.0, -3.5, 4.0], [1.0, 2.0, 3.0, 4.0]]
    assert one(bx.parse_boxes("t"), t="none") == []


def test_report_and_bins(one):
    b = [0.1, 0.2, 0.3, 0.4]
    got = one(bx.grounded_report("s", "b"), "s array<string>, b array<array<array<double>>>", s=["x", "y", "z"], b=[[b, b], [], None])
    assert got == "x [0.10,0.20,0.30,0.40] [0.10,0.20,0.30,0.40]. y. z"
    assert one(bx.boxes_by_label("b", "l", 3), b=[b, [1.0] * 4], l=[2, 0]) == [[[1.0] * 4], [], [b]]
    assert [one(bx.num_boxes_bin(F.array_repeat(F.lit(1), n))) for n in (0, 1, 2, 3, 4, 9)] == [
        "0 boxes", "1 box", "2 boxes", "3-4 boxes", "3-4 boxes", "5+ boxes",
    ]
    v = one(bx.denorm_box("b", F.lit(100), F.lit(50)), b=b)
    assert tuple(v) == pytest.approx((10, 10, 20, 10))

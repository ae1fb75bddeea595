"""Bounding-box expressions over ``array<double>`` boxes.

Unless a name says otherwise a box is (x1, y1, x2, y2) in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Box format names and their synonyms.
FORMATS = {
    "xyxy": "xyxy", "albumentations": "xyxy",
    "cxcywh": "cxcywh", "yolo": "cxcywh",
    "xywh": "xywh", "coco": "xywh",
    "xyxy_nonnormalized": "pixel_xyxy", "pascal_voc": "pixel_xyxy",
}


def xyxy_to_cxcywh(col) -> Column:
    b = _c(col)
    return F.array((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1])


def cxcywh_to_xyxy(col) -> Column:
    b = _c(col)
    return F.array(b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2)


def xywh_to_xyxy(col) -> Column:
    b = _c(col)
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def to_xyxy(col, fmt: str, width=None, height=None) -> Column:
    """Box of any named format as normalised xyxy; pixel formats need the image size."""
    kind = FORMATS.get(fmt)
    if kind is None:
        raise ValueError(f"unknown box format: {fmt}")
    b = _c(col)
    if kind == "xyxy":
        return b
    if kind == "cxcywh":
        return cxcywh_to_xyxy(b)
    if kind == "xywh":
        b = xywh_to_xyxy(b)
    if width is None:
        return b
    return scale_box(b, width, height)


def scale_box(col, width, height) -> Column:
    b, w, h = _c(col), _c(width), _c(height)
    return F.array(b[0] / w, b[1] / h, b[2] / w, b[3] / h)


def norm_xywh(x, y, w, h, width, height, strict: bool = False) -> Column:
    """Pixel (x, y, w, h) to normalised xyxy; sizes must be positive."""
    x, y, w, h, iw, ih = map(_c, (x, y, w, h, width, height))
    ok = (iw > 0) & (ih > 0) & (w > 0) & (h > 0)
    box = F.array(x / iw, y / ih, (x + w) / iw, (y + h) / ih)
    return F.when(ok, box).otherwise(
        F.raise_error(F.lit("box and image sizes must be positive")) if strict else F.lit(None)
    )


def is_valid(col) -> Column:
    b = _c(col)
    return (b[0] < b[2]) & (b[1] < b[3])


def norm_xyxy(box, width, height) -> Column:
    """Pixel xyxy to normalised xyxy with every side clamped to [0, 1]; null if degenerate."""
    w, h = _c(width), _c(height)

    def clamp(v):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    b = _c(box)
    out = F.array(clamp(b[0] / w), clamp(b[1] / h), clamp(b[2] / w), clamp(b[3] / h))
    return F.when((w > 0) & (h > 0), F.when(is_valid(out), out))


def clamp_box(col) -> Column:
    """Raise the minima to 0 and lower the maxima to 1; null if nothing is left."""
    b = _c(col)
    out = F.array(
        F.greatest(F.lit(0.0), b[0]),
        F.greatest(F.lit(0.0), b[1]),
        F.least(F.lit(1.0), b[2]),
        F.least(F.lit(1.0), b[3]),
    )
    return F.when(is_valid(out), out)


def format_box(col, dp: int = 2) -> Column:
    """[a,b,c,d] with dp decimals."""
    mask = "0." + "0" * dp if dp else "0"
    b = _c(col)
    return F.concat(F.lit("["), F.concat_ws(",", *[_number(b[i], mask) for i in range(4)]), F.lit("]"))


def _number(value, mask: str) -> Column:
    return F.call_function("format_number", value, F.lit(mask))


def format_boxes(col, dp: int = 2) -> Column:
    """Boxes of an array, each formatted, joined by blanks."""
    return F.array_join(F.transform(_c(col), lambda b: format_box(b, dp)), " ")


def parse_boxes(col) -> Column:
    """Every [a,b,c,d] in a text as array<array<double>>."""
    found = F.regexp_extract_all(_c(col), F.lit(vocab.BOX), F.lit(0))

    def numbers(s):
        return F.transform(F.split(F.translate(s, "[] \t\n\x0b\f\r", ""), ","), lambda x: x.cast("double"))

    return F.transform(found, numbers)


def let(value: Column, body) -> Column:
    # Bind an expression to a lambda variable, so that it is evaluated once however
    # often the body uses it.
    return F.transform(F.array(value), body)[0]


def _sweep_areas(a: Column, b: Column) -> Column:
    """struct(a, b, ab): areas of the unions of two box lists and of both together, in one sweep.

    The x edges of all boxes are sorted once. In the slab between two of them the boxes that
    span it are active; they come in order of their lower end, and one pass over them adds
    up what either list and both cover.
    """

    def tagged(boxes: Column, side: int) -> Column:
        return F.transform(boxes, lambda v: F.struct(v[1].alias("lo"), v[3].alias("hi"), v[0].alias("l"), v[2].alias("r"), F.lit(side).alias("side")))

    def reach(acc: Column, v: Column, counts: Column) -> Column:
        # Covered length so far and where it ends.
        more = counts & (v["hi"] > acc["end"])
        longer = F.struct((acc["len"] + v["hi"] - F.greatest(v["lo"], acc["end"])).alias("len"), v["hi"].alias("end"))
        return F.when(more, longer).otherwise(acc)

    nothing = F.struct(F.lit(0.0).alias("len"), F.lit(float("-inf")).alias("end"))
    none = F.struct(nothing.alias("a"), nothing.alias("b"), nothing.alias("ab"))

    def covered(active: Column) -> Column:
        def extend(acc: Column, v: Column) -> Column:
            first = v["side"] == 0
            return F.struct(
                reach(acc["a"], v, first).alias("a"), reach(acc["b"], v, ~first).alias("b"), reach(acc["ab"], v, F.lit(True)).alias("ab")
            )

        return F.aggregate(active, none, extend)

    def sweep(by_y: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.concat(F.transform(by_y, lambda v: v["l"]), F.transform(by_y, lambda v: v["r"]))))

        def step(acc: Column, x: Column) -> Column:
            active = F.filter(by_y, lambda v: (v["l"] <= acc["at"]) & (v["r"] >= x))

            def add(c: Column) -> Column:
                width = x - acc["at"]
                return F.struct(*[(acc[k] + width * c[k]["len"]).alias(k) for k in ("a", "b", "ab")], x.alias("at"))

            here = F.struct(*[acc[k].alias(k) for k in ("a", "b", "ab")], x.alias("at"))
            return F.when(acc["at"] > float("-inf"), let(covered(active), add)).otherwise(here)

        start = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "b", "ab")], F.lit(float("-inf")).alias("at"))
        return F.aggregate(edges, start, step)

    return let(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), sweep)


def _area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def _common(p: Column, q: Column) -> Column:
    width = F.least(p[2], q[2]) - F.greatest(p[0], q[0])
    height = F.least(p[3], q[3]) - F.greatest(p[1], q[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def _overlap(p: Column, q: Column) -> Column:
    """The box that two boxes share; without extent if they share none."""
    return F.array(F.greatest(p[0], q[0]), F.greatest(p[1], q[1]), F.least(p[2], q[2]), F.least(p[3], q[3]))


def union_iou(a, b, fmt: str = "xyxy") -> Column:
    """IoU of the unions of two box lists.

    Invalid boxes are dropped; two empty lists score 1, one empty list scores 0. Lists of
    one or two boxes take a closed form by inclusion and exclusion, anything else the
    sweep over x edges.
    """
    a, b = [F.filter(F.transform(_c(x), lambda y: to_xyxy(y, fmt)), is_valid) for x in (a, b)]

    def single(s):
        p, q = s["a"][0], s["b"][0]
        return let(_common(p, q), lambda c: c / (_area(p) + _area(q) - c))

    def few(s):
        # A list of one box counts as that box twice.
        ends = F.struct(
            s["a"][0].alias("p"), F.element_at(s["a"], -1).alias("q"), s["b"][0].alias("r"), F.element_at(s["b"], -1).alias("t")
        )

        def shares(e):
            both = F.struct(_overlap(e["p"], e["q"]).alias("pq"), _overlap(e["r"], e["t"]).alias("rt"))

            def ratio(o):
                one = _area(e["p"]) + _area(e["q"]) - _common(e["p"], e["q"])
                two = _area(e["r"]) + _area(e["t"]) - _common(e["r"], e["t"])
                pairs = sum(_common(x, y) for x in (e["p"], e["q"]) for y in (e["r"], e["t"]))
                threes = sum(_common(o["pq"], y) for y in (e["r"], e["t"])) + sum(_common(x, o["rt"]) for x in (e["p"], e["q"]))
                parts = F.struct((one + two).alias("sum"), F.greatest(F.lit(0.0), pairs - threes + _common(o["pq"], o["rt"])).alias("common"))
                return let(parts, lambda u: u["common"] / (u["sum"] - u["common"]))

            return let(both, ratio)

        return let(ends, shares)

    def general(s):
        return let(_sweep_areas(s["a"], s["b"]), lambda u: F.greatest(F.lit(0.0), u["a"] + u["b"] - u["ab"]) / u["ab"])

    def score(s):
        na, nb = F.size(s["a"]), F.size(s["b"])
        return (
            F.when((na == 0) & (nb == 0), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .when((na == 1) & (nb == 1), single(s))
            .when((na <= 2) & (nb <= 2), few(s))
            .otherwise(general(s))
        )

    return let(F.struct(a.alias("a"), b.alias("b")), score)


def grounded_report(sentences, boxes) -> Column:
    """Sentences joined by '. ', each followed by its own boxes.

    ``boxes`` holds one list of boxes (or null) per sentence.
    """
    pairs = F.zip_with(
        _c(sentences),
        _c(boxes),
        lambda s, bs: F.when(F.coalesce(F.size(bs), F.lit(0)) > 0, F.concat(s, F.lit(" "), format_boxes(bs))).otherwise(s),
    )
    return F.trim(F.array_join(pairs, ". "))


def boxes_by_label(boxes, labels, n) -> Column:
    """Split a flat box list by sentence index into n lists."""
    pairs = F.arrays_zip(_c(boxes).alias("box"), _c(labels).alias("label"))

    def of(i):
        return F.transform(F.filter(pairs, lambda p: p["label"] == i), lambda p: p["box"])

    n = F.lit(n) if isinstance(n, int) else _c(n)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), of)).otherwise(F.array().cast("array<array<array<double>>>"))


def denorm_box(col, width, height) -> Column:
    """Pixel rectangle struct(x, y, w, h) of a normalised box."""
    b, w, h = _c(col), _c(width), _c(height)
    return F.struct(
        (b[0] * w).alias("x"),
        (b[1] * h).alias("y"),
        ((b[2] - b[0]) * w).alias("w"),
        ((b[3] - b[1]) * h).alias("h"),
    )


def num_boxes_bin(col) -> Column:
    n = F.size(_c(col))
    return (
        F.when(n == 0, "0 boxes")
        .when(n == 1, "1 box")
        .when(n == 2, "2 boxes")
        .when(n <= 4, "3-4 boxes")
        .otherwise("5+ boxes")
    )

"""Word boxes from files, maps of transforms, headers of image files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import affine
from quillon.operators import plugins
from quillon.operators import spans as S
from quillon.sources import images, wordboxes

TSV = "\t".join(wordboxes.HEADER)


def words(df):
    return sorted((wordboxes_name(r.file), r.page, r.text, r.left, r.top, r.width, r.height, r.conf) for r in df.collect())


def wordboxes_name(path):
    return path.rsplit("/", 1)[-1]


def test_tsv(spark, tmp_path):
    rows = [
        "1\t1\t0\t0\t0\t0\t0\t0\t640\t480\t-1\t", "5\t1\t1\t1\t1\t1\t10\t20\t30\t12\t96.5\tHello", '5\t1\t1\t1\t1\t2\t50\t20\t30\t12\t90\t"quoted',
        "5\t1\t1\t1\t2\t1\t10\t40\t0\t12\t90\tflat", "5\t1\t1\t1\t2\t2\tx\t40\t5\t12\t90\tbad", "5\t1\t1\t1\t2\t3\t10\t40\t5\t12\t90\t   ", "5\t1\t1\t1\t2\t4\t10\t40",
        "5\t1\t1\t1\t2\t5\t10\t40\t5\t12\thigh\tconf", "4\t1\t1\t1\t2\t0\t10\t40\t5\t12\t90\tline", "5\t2\t1\t1\t1\t1\t1\t2\t3.5\t4\t90\thalf", "5\t2\t1\t1\t1\t2\t1\t2\t3\t4\t90\t été ",
    ]
    (tmp_path / "a.tsv").write_text("\n".join([TSV, *rows]) + "\n")
    (tmp_path / "b.tsv").write_text(TSV + "\r\n" + "5\t1\t1\t1\t1\t1\t0\t0\t2\t2\t1\tleft\r\n")
    got = words(wordboxes.read(spark, str(tmp_path), "tsv"))
    assert got == [
        ("a.tsv", 1, '"quoted', 50, 20, 30, 12, 90.0), ("a.tsv", 1, "Hello", 10, 20, 30, 12, 96.5), ("a.tsv", 2, "été", 1, 2, 3, 4, 90.0),
        ("b.tsv", 1, "left", 0, 0, 2, 2, 1.0),
    ]
    one = wordboxes.read(spark, str(tmp_path), "tsv").where(F.col("file").endswith("b.tsv"))
    assert one.count() == 1
    (tmp_path / "c.tsv").write_text("level\tleft\ttext\n5\t1\tx\n")
    with pytest.raises(Exception, match="unexpected columns of words"):
        wordboxes.read(spark, str(tmp_path), "tsv").collect()
    with pytest.raises(ValueError, match="unknown format"):
        wordboxes.read(spark, str(tmp_path), "pdf")


def test_hocr(spark, tmp_path):
    page = """<div class='ocr_page' id='page_1' title='image "x.png"; bbox 0 0 100 100'>
      <span class='ocr_line' title="bbox 1 2 90 20"><span class='ocrx_word' id='w1' title='bbox 1 2 31 14; x_wconf 93'>R&amp;D &lt;x&gt;</span>
      <span title="x_wconf 7; bbox 40 2 60 14" class="ocrx_word"><strong>bold</strong> &amp;lt;</span>
      <span class='ocrx_word' title='bbox 5 5 5 9'>flat</span> <span class='ocrx_word' title='bbox 1 1 2 2'> </span> <span class='ocrx_word' title='none'>x</span></span></div>"""
    (tmp_path / "a.hocr").write_text(f"<html><body>{page}{page.replace('93', '50')}</body></html>")
    got = words(wordboxes.read(spark, str(tmp_path), "hocr"))
    assert got == [
        ("a.hocr", 1, "R&D <x>", 1, 2, 30, 12, 93.0), ("a.hocr", 1, "bold &lt;", 40, 2, 20, 12, 7.0),
        ("a.hocr", 2, "R&D <x>", 1, 2, 30, 12, 50.0), ("a.hocr", 2, "bold &lt;", 40, 2, 20, 12, 7.0),
    ]


def test_polygons_and_the_recorded_plugin(spark, tmp_path):
    square = [[10.9, 20], [40, 18.2], [41, 30], [9, 31]]
    good = [[square, " word ", 0.9], [square, "", 0.5], [square, "short"], "none", [[[1, 2], [1, 5]], "flat", 0.5], [[[1, "x"], [4, 9]], "letters", 0.5], [[["2", 3], [7, 8]], "text", 0.25], [[], "empty", 1.0]]
    (tmp_path / "w.jsonl").write_text("\n".join([json.dumps({"image": "/data/a.png", "words": good}), json.dumps({"image": "b.jpg", "words": None}), json.dumps({"image": "c"})]))
    got = words(wordboxes.read(spark, str(tmp_path / "w.jsonl"), "polygons"))
    assert got == [("a.png", 1, "text", 2, 3, 5, 5, 0.25), ("a.png", 1, "word", 9, 18, 32, 13, 0.9)]
    plugins.register("ocr", wordboxes.recorded(str(tmp_path / "w.jsonl"), "polygons"))
    samples = spark.createDataFrame([(0, "/images/a.png"), (1, "b.png"), (2, None)], "index long, image_path string")
    out = {r["index"]: [w.text for w in r.words] for r in plugins.apply("ocr", samples).collect()}
    assert out == {0: ["word", "text"], 1: [], 2: []}


def jpeg(width, height, *segments, frame=0xC0):
    out = b"\xff\xd8"
    for n in segments:
        out += b"\xff\xe1" + (n + 2).to_bytes(2, "big") + b"\xff\xc0" * (n // 2) + b"x" * (n % 2)
    return out + b"\xff\xff" + bytes([0xFF, frame]) + (17).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"rest" * 200_000


def test_headers_read_blocks_of_files(spark, tmp_path):
    """Sizes of files and bytes; of an 800 KB file a few blocks are read, whatever lies before the frame."""
    files = {
        "a.jpg": jpeg(640, 480), "b.jpg": jpeg(31, 77, 60_000, 65_000, 3, 12_345, frame=0xC2), "c.jpg": jpeg(9, 8, 5)[:20], "d.jpg": b"\xff\xd8\xff\xda" + b"x" * 50_000,
        "e.png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"x" * 900_000, "f.gif": b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little"),
        "g.bmp": b"BM" + bytes(16) + (33).to_bytes(4, "little") + (44).to_bytes(4, "little"), "h.txt": b"no image", "i.jpg": b"", "j.png": b"\x89PNG\r\n\x1a\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = [(k, f"{'file:' * (k % 2)}{tmp_path}/{name}", None) for k, name in enumerate(files)]
    rows += [(20, "/none.jpg", None), (21, None, None), (22, f"{tmp_path}/a.jpg", bytearray(jpeg(5, 6, 4000)))]
    df = spark.createDataFrame(rows, "index long, image_path string, image_bytes binary")
    got = {r["index"]: r for r in images.headers(df, str(tmp_path)).collect()}
    heads = {k: tuple(r.header) if r.header else None for k, r in got.items()}
    assert heads == {
        0: ("jpeg", 640, 480), 1: ("jpeg", 31, 77), 2: ("jpeg", None, None), 3: ("jpeg", None, None), 4: ("png", 640, 480), 5: ("gif", 300, 7), 6: ("bmp", 33, 44),
        7: None, 8: None, 9: None, 20: None, 21: None, 22: ("jpeg", 5, 6),
    }
    assert got[0].bytes_read == got[4].bytes_read == images.BLOCK and got[1].bytes_read <= 10 * images.BLOCK and got[22].bytes_read == 0
    assert set(images.headers(df).where("header is not null").toPandas()["index"]) == {22}


def plain_map(name, w, h):
    if name == "crop":
        kw, kh = int(w * 0.82), int(h * 0.82)
        left, top = (w - kw) // 2, (h - kh) // 2
        return lambda x, y: ((x - left) * w / kw, (y - top) * h / kh)
    if name == "rerender":
        return lambda x, y: ((x + 26) * w / (w + 52), (y + 50) * h / (h + 92))
    return lambda x, y: (x, y)


def test_maps_of_transforms(spark):
    """Every transform and chains of them against points moved one by one; the inverse leads back."""
    rng = random.Random(1)
    rows = []
    for i in range(60):
        names = [rng.choice(affine.TRANSFORMS) for _ in range(i % 4)]
        l, t = rng.randint(0, 900), rng.randint(0, 700)
        rows.append((names, rng.randint(600, 2001), rng.randint(500, 1500), l, t, l + rng.randint(1, 90), t + rng.randint(1, 50)))
    df = spark.createDataFrame(rows, "names array<string>, w int, h int, l int, t int, r int, b int")
    m = affine.of_chain(F.col("names"), F.col("w"), F.col("h"))
    rows = df.withColumn("map", affine.once(m)).withColumn("there", affine.mapped(F.col("map"), F.struct("l", "t", "r", "b")))
    rows = rows.withColumn("back", affine.mapped(affine.inverse(F.col("map")), F.col("there")))
    for r in rows.withColumn("seen", affine.clipped(F.col("there"), F.col("w"), F.col("h"))).collect():
        ends = [(r.l, r.t), (r.r, r.b)]
        for name in r.names:
            ends = [plain_map(name, r.w, r.h)(*p) for p in ends]
        (l, t), (right, b) = ends
        assert tuple(r.there) == pytest.approx((l, t, right, b)) and tuple(r.back) == pytest.approx((r.l, r.t, r.r, r.b))
        cut = (max(min(l, r.w), 0), max(min(t, r.h), 0), max(min(right, r.w), 0), max(min(b, r.h), 0))
        assert r.seen is None if cut[2] <= cut[0] or cut[3] <= cut[1] else tuple(r.seen) == pytest.approx(cut)
    unknown = spark.range(1).select(affine.of_transform(F.lit("warp"), F.lit(10), F.lit(10)).alias("m")).first().m
    assert unknown is None


def test_consensus_of_transforms(spark):
    """A box that the crop and the rerendered view show where they should is confirmed by both, one found elsewhere by none."""
    box = "struct<l:double,t:double,r:double,b:double>"
    primary = spark.createDataFrame([(1, 0, (300.0, 300.0, 400.0, 340.0)), (1, 1, (500.0, 500.0, 560.0, 520.0))], f"image_id int, box_id int, box {box}")
    rows = []
    for names in (["crop"], ["rerender"], ["crop", "rerender"]):
        ends = [(300, 300), (400, 340)]
        for n in names:
            ends = [plain_map(n, 1000, 800)(*p) for p in ends]
        rows.append((1, names, 1000, 800, (*ends[0], *ends[1])))
    rows.append((1, ["blur"], 1000, 800, (700.0, 500.0, 760.0, 520.0)))
    rows.append((1, ["jpeg"], 1000, 800, (-50.0, -50.0, -10.0, -10.0)))
    found = spark.createDataFrame([(*r[:4], tuple(map(float, r[4]))) for r in rows], f"image_id int, transforms array<string>, width int, height int, box {box}")
    got = S.consensus_of_transforms(primary, found, least_views=2).collect()
    assert [(r.box_id, r.n_views) for r in got] == [(0, 3)]


def test_cells_meet_every_pair_once(spark):
    rng = random.Random(4)
    boxes = [(1, i, (l, t, l + rng.randint(1, 1500), t + rng.randint(1, 300))) for i in range(120) for l, t in [(rng.randint(-600, 2000), rng.randint(-100, 900))]]
    box = "struct<l:int,t:int,r:int,b:int>"
    a = spark.createDataFrame(boxes, f"image_id int, box_id int, box {box}")
    v = a.select("image_id", F.col("box_id").alias("view"), "box")

    def iou(p, q):
        both = max(min(p[2], q[2]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[1], q[1]), 0)
        area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        return both / (area(p) + area(q) - both)

    want = {i: sum(iou(p, q) >= 0.3 for _, _, q in boxes) for _, i, p in boxes}
    assert {r.box_id: r.n_views for r in S.consensus(a, v).collect()} == want

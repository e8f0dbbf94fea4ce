import pathlib
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool import streaming
from tidepool.errors import ConfigError, NotFoundError, StateError, ValidationError
from tidepool.operators import pixels
from tidepool.operators.checks import Check
from tidepool.operators.computers import PER_IMAGE, Computer, Registry, builtin, decode, run_parameters
from tidepool.plans.cleaner import BasicCleaner
from tidepool.sources import annotations, images, importer, raw, urls
from tidepool.sources.storage import Prefix, Storage, safe_path
from tidepool.storing import shared_dir
from tidepool.sources.tabular import Dataset, fingerprint, grid_limit, register_format, sample, sorted_by, with_position


def png(x, extra=b""):
    h, w = x.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines = b"".join(b"\0" + row.tobytes() for row in x.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if x.shape[2] == 3 else 6, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def jpeg_header(w, h, orientation=6):
    exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 274, 3, 1, orientation, 0) + b"\0\0\0\0"
    segment = lambda k, d: b"\xff" + bytes([k]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\x01" + struct.pack(">HH", 72, 96) + b"\0\0") + segment(0xE1, exif) + segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\0" * 9) + b"\xff\xd9"


RNG = np.random.default_rng(1)
NOISY = RNG.integers(0, 256, (24, 32, 3))
PICTURES = {"noisy": NOISY, "copy": NOISY, "white": np.full((24, 24, 3), 255), "framed": np.pad(RNG.integers(30, 200, (10, 10, 3)), ((5, 5), (5, 5), (0, 0)), constant_values=255)}


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    for n, x in PICTURES.items():
        (d / ("deep" if n == "white" else "") / f"{n}.PNG").write_bytes(png(x))
    (d / "broken.jpg").write_bytes(b"no image")
    (d / "notes.txt").write_text("x")
    return d


def rows(spark, folder):
    return images.directory(spark, str(folder)).withColumn("image_id", F.regexp_extract("image_uri", r"([^/]*)\.\w+$", 1))


def test_kernels():
    assert decode(png(NOISY))[0].tolist() == NOISY.tolist()
    assert decode(b"x")[0] is None and decode(None) == (None, "no data")
    x = PICTURES["framed"]
    assert pixels.border(x)["border_padding_sides"] == "top,bottom,left,right" and pixels.border(x)["border_padding_ratio"] >= 0.5
    assert pixels.border(np.full((20, 20, 3), (20, 80, 140)))["border_padding_ratio"] == 0
    flat = pixels.gray(np.full((8, 8, 3), 100))
    assert pixels.quality(flat) == {"blur_score": 0.0, "brightness_score": 100.0, "contrast_score": 0.0, "blank_score": 1.0}
    a, b = (pixels.phash(pixels.gray(v)) for v in (NOISY, np.clip(NOISY + 3, 0, 255)))
    assert len(a) == 16 and (int(a, 16) ^ int(b, 16)).bit_count() <= 6
    assert pixels.frame_count(png(NOISY, struct.pack(">I", 8) + b"acTL" + struct.pack(">II", 3, 0) + b"\0\0\0\0")) == 3
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + 2 * (b"!\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0") + b";"
    assert pixels.frame_count(gif) == 2
    facts = images.raw_facts(jpeg_header(16, 8))
    assert (facts["width"], facts["height"], facts["exif_orientation"], facts["dpi_x"], facts["dpi_y"]) == (16, 8, 6, 72.0, 96.0)


def test_a_run_from_images_to_views(spark, folder, tmp_path):
    cleaner = BasicCleaner(["decode", "quality", "blank", "border_padding", "animated", "orientation", "duplicate", "size"], Registry(builtin(lambda xs: np.array([[x.mean(), 255 - x.mean()] for x in xs], np.float32) / 255)))
    events = []
    result = cleaner.run(rows(spark, folder), str(tmp_path / "out"), run_id="r", label="first", progress=lambda e, _: events.append(e))
    assert result.status == "completed", result.state()["error"]
    assert events == ["started", "parameters", "completed"]
    got = {r["image_id"]: r["final_action"] for r in result.evaluations().collect()}
    assert got["broken"] == "drop" and got["white"] == "drop" and sorted([got["noisy"], got["copy"]])[0] == "drop"
    views = {k: result.view(k).count() for k in ("clean", "review", "dropped", "restricted", "full")}
    assert sum(v for k, v in views.items() if k != "full") == views["full"] == 5
    assert result.summary()["total"] == 5 and result.operators().count() == len(cleaner.config.checks)
    assert result.relations("exact_duplicate").count() == 1
    assert result.explain("white")["blank_action"] == "drop"
    assert result.operator("blank").columns == ["image_id", "blank_score", "blank_action", "blank_reason"]
    assert result.state_frame().count() == len(cleaner.config.checks)
    with pytest.raises(KeyError):
        result.operator("none")
    with pytest.raises(NotFoundError):
        result.explain("none")
    assert result.manifest()["summary"]["total"] == 5
    assert zipfile.ZipFile(result.export_debug(str(tmp_path / "debug.zip"))).namelist() == ["state.json", "manifest.json", "parameters.jsonl", "evaluations.jsonl"]
    page = result.preview_html("exact_duplicate", include_group_context=True)
    assert page.count("<figure>") == 2
    assert Dataset.load(str(tmp_path / "clean.csv")).format == "csv"
    result.export("clean", str(tmp_path / "clean.jsonl"))
    assert spark.read.json(str(tmp_path / "clean.jsonl")).count() == views["clean"]
    # The same run again is the stored one; another plan is refused; other thresholds need no images.
    assert cleaner.run(rows(spark, folder), str(tmp_path / "out"), run_id="r").status == "completed"
    with pytest.raises(StateError):
        BasicCleaner(["decode"]).run(rows(spark, folder), str(tmp_path / "out"), run_id="r")
    again = BasicCleaner([{"brightness": {"min_score": 0.0, "max_score": 1.0}}]).reevaluate(result)
    assert again.summary()["review"] == 4


def jpeg(spark, x):
    """The bytes of a JPEG that the JVM writes of an image."""
    jvm, h, w = spark._jvm, *x.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 5 if x.ndim == 3 else 10)
    for i in range(h):
        for j in range(w):
            image.getRaster().setSample(j, i, 0, int(x[i, j] if x.ndim == 2 else x[i, j, 0]))
            if x.ndim == 3:
                image.getRaster().setSample(j, i, 1, int(x[i, j, 1]))
                image.getRaster().setSample(j, i, 2, int(x[i, j, 2]))
    return _written(jvm, image, "jpg")


def _written(jvm, image, kind):
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, kind, out)
    return bytes(out.toByteArray())


def test_formats_are_decoded_on_the_default_path(spark):
    smooth = np.add.outer(np.arange(16) * 6, np.arange(24) * 4)[:, :, None] + np.array([0, 40, 5])
    jvm = spark._jvm
    indexed = jvm.java.awt.image.BufferedImage(5, 16, 13)
    binary = jvm.java.awt.image.BufferedImage(11, 16, 12)
    for i in range(16):
        for j in range(5):
            indexed.setRGB(j, i, -65536 if (i + j) % 2 else -1)
        for j in range(11):
            binary.setRGB(j, i, -1 if (i * 11 + j) % 3 == 0 else -16777216)
    checker = np.array([[(255, 0, 0) if (i + j) % 2 else (255, 255, 255) for j in range(5)] for i in range(16)])
    dots = np.array([[(255,) * 3 if (i * 11 + j) % 3 == 0 else (0,) * 3 for j in range(11)] for i in range(16)])
    alpha = np.dstack([NOISY, np.full(NOISY.shape[:2], 9)])
    cases = {
        "jpeg": (jpeg(spark, smooth), smooth, 6), "gray": (jpeg(spark, smooth[:, :, 0]), np.repeat(smooth[:, :, :1], 3, 2), 6), "png": (png(NOISY), NOISY, 0), "alpha": (png(alpha), NOISY, 0),
        "gif": (_written(jvm, indexed, "gif"), checker, 0), "palette": (_written(jvm, indexed, "png"), checker, 0), "bits": (_written(jvm, binary, "png"), dots, 0), "bits_gif": (_written(jvm, binary, "gif"), dots, 0),
    }
    bad = {"cut": png(NOISY)[:200], "header": jpeg_header(16, 8), "webp": b"RIFF\0\0\0\0WEBPVP8 ", "text": b"no image", "none": None}
    df = spark.createDataFrame([(n, bytearray(c[0])) for n, c in cases.items()] + [(n, None if b is None else bytearray(b)) for n, b in bad.items()], "image_id string, content binary")
    flat = Computer("flat", PER_IMAGE, {"flat": "string"}, image=lambda x, c: {"flat": "" if x.rgb is None else ",".join(map(str, [*x.rgb.shape, *x.rgb.ravel()]))})
    out, _ = run_parameters(df, ["decode_ok", "decode_error", "format", "flat"], Registry([*builtin(), flat]))
    got = {r["image_id"]: r for r in out.collect()}
    for n, (_, x, near) in cases.items():
        assert got[n]["decode_ok"], (n, got[n]["decode_error"])
        v = np.array(got[n]["flat"].split(","), int)
        assert tuple(v[:3]) == x.shape and np.abs(v[3:].reshape(x.shape) - x).max() <= near, n
    assert not any(got[n]["decode_ok"] for n in bad) and got["webp"]["decode_error"] == "ValueError: cannot decode WEBP data" and got["cut"]["decode_error"]


def test_each_image_is_decoded_once(spark, folder, tmp_path):
    log = tmp_path / "seen"

    def seen(x, c):
        with log.open("ab") as f:
            f.write(b".")
        return {"seen": 1}

    registry = Registry([*builtin(), Computer("counter", PER_IMAGE, {"seen": "int"}, image=seen)])
    check = Check("seen", "test", ("seen",), {"action": "review"}, lambda c: (F.lit(False), F.lit("")))
    cleaner = BasicCleaner([check, "exact_duplicate", "perceptual_duplicate", "blur"], registry)
    kept = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = sorted(p.name.split("-")[0] for p in kept.iterdir())
    result = cleaner.run(rows(spark, folder), str(tmp_path / "out"), run_id="r")
    assert result.status == "completed", result.state()["error"]
    assert log.stat().st_size == 5
    assert sorted(p.name.split("-")[0] for p in kept.iterdir()) == before  # nothing of the run's own is left there
    assert set(result.state_frame().select("operator_name", "processed_count", "failed_count").collect()) == {("seen", 5, 0), ("exact_duplicate", 5, 0), ("perceptual_duplicate", 5, 0), ("blur", 4, 1)}
    assert result.operator("blur").columns == ["image_id", "blur_score", "blur_action", "blur_reason"]


def test_dry_run_sample_and_failures(spark, folder, tmp_path):
    cleaner = BasicCleaner(["semantic_duplicate"])
    assert cleaner.dry_run(["image_id"]).errors
    with pytest.raises(ConfigError):
        cleaner.run(rows(spark, folder), str(tmp_path))
    plain = BasicCleaner(["dimension"])
    part = plain.run(rows(spark, folder), str(tmp_path), sample_size=2)
    assert part.evaluations().count() == 2 and part.state()["sample"]["n"] == 2

    def fails(x, c):
        raise RuntimeError("broken kernel")

    bad = BasicCleaner(["blur"], Registry([Computer("c", PER_IMAGE, {"blur_score": "double"}, image=fails)]))
    assert bad.run(rows(spark, folder), str(tmp_path)).status == "failed"


def test_plans():
    r = Registry(builtin())
    assert [c.name for c, _ in r.plan(["aspect_ratio", "exact_duplicate_count"], ["content"])] == ["image_hash_computer", "image_metadata_computer", "table_derived_computer", "duplicate_group_computer"]
    assert r.plan(["aspect_ratio"], ["width", "height"])[0][1] == ("aspect_ratio",)
    with pytest.raises(ConfigError):
        r.plan(["nothing"], [])
    with pytest.raises(ConfigError):
        r.register(Computer("other", PER_IMAGE, {"phash": "string"}))
    loop = Registry([Computer("a", "table", {"x": "int"}, ("y",)), Computer("b", "table", {"y": "int"}, ("x",))])
    with pytest.raises(ConfigError):
        loop.plan(["x"], [])
    one, two = BasicCleaner(["blur"]).compile(["content"]), BasicCleaner([{"blur": {"min_score": 1.0}}]).compile(["content"])
    assert one.plan_hash != two.plan_hash and one.parameter_hash == two.parameter_hash


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0, "s"), (2, "b", None, "s"), (3, "a", float("nan"), "s")], "id int, k string, v double, source_uri string")
    for name in ("t.parquet", "t.csv", "t.jsonl"):
        d = Dataset.write(df.coalesce(1), str(tmp_path / name))
        assert d.scan(spark, ["id", "id"], {"k": "a"}).orderBy("id").collect() == [(1,), (3,)]
        assert d.count(spark) == 3
    register_format(".tsv", lambda s, p: s.read.option("sep", "\t").option("header", True).csv(p), lambda d, p: d.write.option("sep", "\t").option("header", True).csv(p))
    assert Dataset.write(df, str(tmp_path / "t.tsv")).frame(spark, ["k"]).count() == 3
    d = Dataset.load(str(tmp_path / "t.parquet"))
    assert d.fingerprint(spark) == fingerprint(df.repartition(3)) != fingerprint(df.limit(2))
    assert "source_uri" not in d.export(spark, str(tmp_path / "e.parquet")).frame(spark).columns
    with pytest.raises(ValueError):
        Dataset.load("x.txt")
    ordered = with_position(df, ["id"])
    assert [r["id"] for r in sorted_by(ordered, ["v"], "desc").collect()] == [1, 2, 3]
    for bad in ((["id", "k"], "asc"), (["id"], "up")):
        with pytest.raises(ValueError):
            sorted_by(df, *bad)
    assert grid_limit(2, 3, 5) == 5
    assert {r["id"] for r in sample(ordered, 2, "s", "id").collect()} == {r["id"] for r in sample(ordered.repartition(3), 2, "s", "id").collect()}


def test_import(spark, folder, tmp_path):
    out = importer.run_import(importer.from_directory(spark, str(folder)), str(tmp_path / "store"), str(tmp_path / "imported"), tags=("scene/a", "scene/a"), max_shard_size=2)
    assert out.report["succeeded"] == 4 and out.report["failed"] == 1
    table = spark.read.parquet(out.raw_path)
    raw.validate(table)
    assert table.columns == list(raw.RAW_COLUMNS)
    assert sorted(r[0] for r in table.select(F.regexp_extract("image_uri", r"shard_(\d+)", 1)).collect()) == ["001", "001", "002", "002"]
    assert images.read_by_uri(table.select("image_uri")).where("ok").count() == 4
    with pytest.raises(ValidationError):
        raw.validate(table.drop("tags"))
    with pytest.raises(ValidationError):
        raw.validate(table.withColumn("tags", F.array(F.lit("a//b"))))


def test_import_fetches_each_address_once(spark, tmp_path):
    log = tmp_path / "fetched"

    def get(url):
        with log.open("a") as f:
            f.write(url + "\n")
        if "bad" in url:
            raise OSError("gone")
        return png(NOISY) if "text" not in url else b"no image"

    addresses = [f"https://a.example/{n}.png" for n in ("one", "two", "bad", "three", "text")] + ["ftp://a.example/x.png"]
    out = importer.run_import(importer.from_urls(spark.createDataFrame([(u,) for u in addresses], "url string"), get), f"file://{tmp_path}/store", str(tmp_path / "out"))
    assert sorted(log.read_text().split()) == sorted(addresses[:5])
    assert out.report["succeeded"] == 3 and out.report["failed"] == 3
    failed = {(r["source_uri"].rsplit("/", 1)[-1], r["stage"]) for r in spark.read.json(out.failure_path).collect()}
    assert failed == {("bad.png", "source"), ("text.png", "metadata"), ("x.png", "source")}
    assert images.read_by_uri(spark.read.parquet(out.raw_path).select("image_uri")).where("ok").count() == 3
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".staging")]
    gone = images.read_by_uri(spark.createDataFrame([(None,), ("/no/such/file",), (f"{tmp_path}/fetched",)], "image_uri string"))
    assert sorted(r["ok"] for r in gone.collect()) == [False, False, True]


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in ("https://a.example/x.jpg?y", "ftp://a/x.jpg", "http://localhost/x.jpg", "http://10.1.2.3/x.png", "http://[::1]/x.png", "https://a.example/x.txt", "https://u:p@127.0.0.1/x.gif", None)], "url string")
    assert [r[0] == "" for r in df.select(urls.url_error("url")).collect()] == [True] + [False] * 7
    got = urls.download(df, lambda u: png(NOISY)).collect()
    assert sum(r["content"] is not None for r in got) == 1


def test_annotations(spark, folder, tmp_path):
    box = {"x_min": 0.1, "y_min": 0.0, "x_max": 0.5, "y_max": 1.0}
    note = [{"label": "cat", "bbox": box, "format": "relative", "source": "s", "difficult": 0, "truncated": 1, "pose": None}]
    df = spark.createDataFrame([("a", bytearray(b"x"), "/m/a.png", 100, 50, note), ("b", bytearray(b"y"), "/m/b.png", 10, 10, [])], f"image_id string, content binary, image_uri string, width int, height int, annotations {annotations.ANNOTATIONS}")
    to = annotations.export_labelimg(df, str(tmp_path / "li"))
    voc = annotations.read_voc(spark, f"{to}/images")
    back, report = annotations.attach(df.drop("annotations"), voc)
    found = {r["image_id"]: r["annotations"] for r in back.collect()}
    assert found["b"] == [] and found["a"][0]["label"] == "cat" and found["a"][0]["bbox"]["x_max"] == 0.5 and report.count() == 0
    with pytest.raises(ValidationError):
        annotations.attach(df.drop("annotations").where("image_id = 'b'"), voc)
    assert annotations.attach(df.drop("annotations").withColumn("width", F.lit(7)), voc, strict=False)[1].count() == 1
    with pytest.raises(ValidationError):
        annotations.export_labelimg(df.union(df), str(tmp_path / "x"))
    assert df.select(F.size(annotations.box_errors("annotations"))).first()[0] == 0


def test_storage(spark, tmp_path):
    s = Storage(spark, Prefix("p", "main", "file", f"file://{tmp_path}/s"))
    asset, path = s.write_managed(b"abc")
    assert s.write_managed(b"abc") == (asset, path) and s.read(path) == b"abc"
    s.verify(asset, path)
    s.copy(path, "x/y")
    s.move("x/y", "x/z")
    assert s.exists("x/z") and not s.exists("x/y")
    assert [r["ok"] for r in s.batch(s.read, [path, "none"])] == [True, False]
    for bad in ("/a", "../a", "a/../b", "", "c:/x", "a//b"):
        with pytest.raises(ValueError):
            safe_path(bad)


def test_streaming(spark, folder, tmp_path):
    cleaner = BasicCleaner(["decode", "blank"])
    stream = streaming.cleaned(streaming.images(spark, str(folder)), cleaner).select("image_uri", "final_action")
    streaming.write(stream, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    got = {r[0].rsplit("/", 1)[-1]: r[1] for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    assert got["white.PNG"] == "drop" and got["noisy.PNG"] == "keep" and got["broken.jpg"] == "drop"
    with pytest.raises(ConfigError):
        streaming.cleaned(rows(spark, folder), BasicCleaner(["exact_duplicate"]))

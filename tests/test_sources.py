import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.operators import augment, raster, validation
from foliolake.sources import manifests, rasters, sinks


def png(plane):
    """A gray PNG by hand."""
    plane = np.asarray(plane, dtype=np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", plane.shape[1], plane.shape[0], 8, 0, 0, 0, 0)
    body = b"".join(b"\0" + row.tobytes() for row in plane)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


PLANE = np.arange(35).reshape(5, 7) * 7


@pytest.fixture
def store(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.png").write_bytes(png(PLANE))
    (tmp_path / "deep" / "b.png").write_bytes(png(255 - PLANE))
    (tmp_path / "recipe.json").write_text("{}")
    return tmp_path


def test_raster_scan_and_header(spark, store):
    found = {r.path: r for r in rasters.stored_artifacts(spark, str(store)).collect()}
    assert set(found) == {"a.png", "deep/b.png", "recipe.json"}
    assert (found["a.png"].width, found["a.png"].height) == (7, 5) and found["recipe.json"].width is None
    assert found["a.png"].sha256 == hashlib.sha256(png(PLANE)).hexdigest()
    assert rasters.raster_sources(spark, str(store)).count() == 2
    with pytest.raises(ValueError):
        rasters.raster_sources(spark, str(store), "*.tif")


def test_contents_are_not_read_without_hashes(spark, store):
    plan = rasters.list_files(spark, str(store))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_pixels_and_image_hash(spark, store):
    scan = rasters.read_scanlines(spark, str(store / "a.png"))
    rows = [list(r["values"]) for r in scan.orderBy("y").collect()]
    assert rows == PLANE.tolist()
    images = spark.read.format("image").load(str(store / "a.png")).withColumn("page_id", F.lit(1))
    got = augment.image_hash(images).first().pixel_sha256
    assert got == hashlib.sha256(b"L\x007x5\x00" + PLANE.astype(np.uint8).tobytes()).hexdigest()


def test_colour_goes_to_luma_over_white(spark):
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    data = bytearray([10, 20, 30, 255, 10, 20, 30, 0])  # BGRA: one opaque and one clear pixel
    df = spark.createDataFrame([(1, ("x", 1, 2, 4, 24, data))], f"page_id int, image {image}")
    luma = (30 * 19595 + 20 * 38470 + 10 * 7471 + 32768) >> 16
    assert list(raster.gray_from_image(df).first()["values"]) == [luma, 255]


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [f"row {i}" if i % 97 else "" for i in range(1, 4001)]
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.jsonl").write_text("only")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = manifests.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {(r.file[-9:], r.line_no): r.value for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {**{("one.jsonl", i + 1): v for i, v in enumerate(lines)}, ("two.jsonl", 1): "only"}


def test_empty_manifest_is_an_error(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("")
    (tmp_path / "f.jsonl").write_text("{}")
    lines = manifests.read_lines(spark, str(tmp_path))
    lines = lines.withColumn("file", F.regexp_extract("file", r"[^/]*$", 0))
    listed = spark.createDataFrame([("e.jsonl",), ("f.jsonl",)], "file string")
    assert [r.file for r in manifests.empty_files(listed, lines).collect()] == ["e.jsonl"]


ASSET = {
    "id": "a", "title": "t", "composer": "c", "work_identifier": "w", "source_url": "https://e.org/x", "source_file": "a.ly",
    "source_sha256": "0" * 64, "composition_rights": {"status": "public_domain", "basis": "old"},
    "source_file_rights": {"status": "compatible_license", "basis": "b", "license": "CC", "license_url": "https://cc.org"},
    "verified_date": "2026-08-13", "notes": "n",
}


def test_asset_manifest_and_catalogue(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "scores": [ASSET, {**ASSET, "verified_date": "2026-02-30"}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": 2, "scores": []}))
    rows = manifests.read_asset_manifest(spark, str(tmp_path / "m.json"))
    assert [(r.line_no, r.id) for r in rows.orderBy("line_no").collect()] == [(0, "a"), (1, "a")]
    assert [(r.line_no, r.rule) for r in validation.asset_problems(rows).collect()] == [(1, "verified_date")]
    assert [r.message for r in manifests.asset_manifest_problems(spark, str(tmp_path)).collect()] == ["schema_version must be 1"]
    work = {"id": "w", "composer": "c", "death_year": 1750, "work": "x", "path": "p", "coverage": "v"}
    (tmp_path / "c.txt").write_text(json.dumps({"schema_version": 1, "upstream": {"repository": "r", "commit": "k", "source_file_rights_basis": "b"}, "scores": [work, work]}))
    works = manifests.read_catalogue(spark, str(tmp_path / "c.txt"))
    found = {r.rule for r in validation.catalogue_problems(works, 40, tuple(work)).collect()}
    assert works.first().commit == "k" and found == {"work_count", "duplicate_id"}


def test_metadata(spark, tmp_path):
    (tmp_path / "dataset.json").write_text(json.dumps({"schema_version": 1, "dataset_id": "d", "sample_count": 3, "source_splits": {"s": "train"}}, indent=1))
    row = manifests.read_dataset_metadata(spark, str(tmp_path)).first()
    assert (row.dataset_id, row.sample_count, row.source_splits) == ("d", 3, {"s": "train"})


def test_typed_samples_keep_unsigned_seed(spark):
    text = json.dumps({"sample_id": "s", "render_parameters": {"layout_seed": 2**64 - 1}, "degradations": [{"order": 1, "family": "blur", "seed": 5, "parameters": {"radius": 1.5}}]})
    row = manifests.read_samples(spark.createDataFrame([("f", 1, text)], "file string, line_no bigint, value string")).first()
    assert int(row.render_parameters.layout_seed) == 2**64 - 1 and row.degradations[0].family == "blur"


def test_sample_table(spark):
    table = rasters.SampleTable(spark.createDataFrame([(i + 1, f"s{i}") for i in range(9)], "line_no bigint, sample_id string").repartition(4))
    assert len(table) == 9 and table[0].sample_id == "s0" and table[-1].sample_id == "s8"
    assert [r.sample_id for r in table[2:7:2].orderBy("line_no").collect()] == ["s2", "s4", "s6"]
    assert [r.sample_id for r in table] == [f"s{i}" for i in range(9)]
    with pytest.raises(IndexError):
        table[9]


def test_bundles_with_and_without_masks(spark, scan_of):
    paths = {"input": 1, "clean": 2, "mask_background": 3, "mask_staff": 4, "mask_notation": 5, "mask_text": 6}
    scan = scan_of({n: [[n]] for n in paths.values()}).withColumn("page_id", F.concat(F.lit("p"), "page_id"))
    samples = spark.createDataFrame(
        [("s", "p1", "p2", {"background": "p3", "staff": "p4", "notation": "p5", "text": "p6"})],
        "sample_id string, input_path string, clean_target_path string, mask_paths map<string,string>",
    )
    row = rasters.load_samples(samples, scan).first()
    assert [row[r] for r in paths] == [[n] for n in paths.values()]
    assert rasters.load_samples(samples.drop("mask_paths"), scan, masks=False).columns == ["sample_id", "y", "input", "clean"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", None), (0, "a", 1.5)], "task_index int, z string, dice double")
    sinks.write_manifest(rows, str(tmp_path / "m"))
    text = [r.value for r in manifests.read_lines(spark, str(tmp_path / "m")).orderBy("file", "line_no").collect()]
    assert text == ['{"dice":1.5,"task_index":0,"z":"a"}', '{"dice":null,"task_index":1,"z":"b"}']
    with pytest.raises(Exception):
        sinks.write_manifest(rows, str(tmp_path / "m"))
    sinks.write_metrics([rows.select("z", "dice"), rows.select("z", F.lit(2).alias("extra"))], str(tmp_path / "x"))
    assert spark.read.csv(str(tmp_path / "x/csv"), header=True).columns == ["z", "dice", "extra"]


def test_output_is_complete_only_after_its_checks(spark, tmp_path):
    rows = spark.range(3)
    assert not sinks.is_complete(spark, str(tmp_path / "o"))
    sinks.commit_output(spark, rows, str(tmp_path / "o"), lambda w: w.where("id < 0"))
    assert sinks.is_complete(spark, str(tmp_path / "o"))
    with pytest.raises(ValueError):
        sinks.commit_output(spark, rows, str(tmp_path / "bad"), lambda w: w.where("id = 1"))
    assert not sinks.is_complete(spark, str(tmp_path / "bad"))
    with pytest.raises(Exception):
        sinks.commit_output(spark, rows, str(tmp_path / "o"))


def test_artifacts_against_storage(spark, store):
    stored = rasters.stored_artifacts(spark, str(store))
    good = hashlib.sha256(png(PLANE)).hexdigest()
    declared = spark.createDataFrame(
        [("f", 1, 7, 5, "input", "a.png", good), ("f", 2, 9, 5, "input", "a.png", good), ("f", 3, 7, 5, "clean", "a.png", "1" * 64),
         ("f", 4, 7, 5, "clean", "gone.png", good), ("f", 5, 7, 5, "clean", "../a.png", good)],
        "file string, line_no int, width int, height int, role string, path string, sha256 string",
    )
    found = {(r.line_no, r.rule) for r in validation.artifact_problems(declared, stored).collect()}
    assert found == {(2, "artifact_size"), (3, "artifact_hash"), (4, "artifact_missing")}
    listed = rasters.stored_artifacts(spark, str(store), with_hash=False)
    found = {(r.line_no, r.rule) for r in validation.artifact_problems(declared, listed, verify_hashes=False).collect()}
    assert found == {(2, "artifact_size"), (4, "artifact_missing")}


def test_headers_of_real_files_and_odd_ones(spark, tmp_path):
    import struct
    import zlib

    from foliolake.sources import headers, sinks

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0abc" * 2)) + chunk(b"IEND", b"")
    files = {
        "a/one.PNG": (png, ("png", 3, 2)), "a/empty.png": (b"", (None, None, None)), "b/cut.jpg": (b"\xff\xd8\xff\xc0", ("jpeg", None, None)),
        "b/late.jpeg": (b"\xff\xd8" + b"\xff\xe1\x03\x02" + b"x" * 768 + b"\xff\xc2\x00\x11\x08\x00\x07\x00\x09\x03", ("jpeg", 9, 7)),
        "c/none.tif": (b"II*\0\xff\0\0\0", ("tiff", None, None)), "c/text.txt": (png, None),
    }
    rows = spark.createDataFrame([(k, bytearray(v[0])) for k, v in files.items()], "path string, content binary")
    assert sinks.write_files(rows, str(tmp_path)) == 6
    found = headers.read_headers(spark, str(tmp_path))
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.format, r.width, r.height) for r in found.collect()}
    assert got == {k: v[1] for k, v in files.items() if v[1]}
    assert headers.read_headers(spark, str(tmp_path / "c"), ".gif").count() == 0


def test_lines_are_numbered_over_small_splits(spark, tmp_path):
    text = "\n".join(f"line {k} " + "x" * (k % 50) for k in range(3000))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text("only")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = manifests.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        found = {(r.file.rpartition("/")[2], r.line_no): r.value for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {("a.jsonl", k + 1): v for k, v in enumerate(text.split("\n"))} | {("b.jsonl", 1): "only"}


@pytest.mark.parametrize("tile, overlap, a, b", [(8, 0, 0.5, 0.5), (40, 8, 0.5, 0.5), (32, 32, 0.5, 0.5), (32, -1, 0.5, 0.5), (32, 8, 1.5, 0.5), (32, 8, 0.5, -0.1)])
def test_settings_that_no_page_can_be_scored_with_are_refused(tile, overlap, a, b):
    from foliolake.operators import tiles

    with pytest.raises(ValueError):
        tiles.check_settings(tile, overlap, a, b)


def test_a_brand_is_one_manifest(spark):
    """Positions run on through a brand, however far its keys lie apart."""
    from foliolake.catalog.sources import asset_manifest_scan

    sf = "/root/testdata/sf0.01"
    most = spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").count().agg(F.max("count")).first()[0]
    assert asset_manifest_scan(spark, sf).agg(F.max("line_no")).first()[0] == most - 1


def test_descriptions_lie_in_few_folders(spark, tmp_path, monkeypatch):
    """One file per supplier, but no folder per supplier."""
    from foliolake.catalog import pages

    spark.range(1, 501).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(pages, "scratch", lambda spark: str(tmp_path / "files"))
    found = {r.id: r.message for r in pages.metadata_file_problems(spark, str(tmp_path)).collect()}
    assert set(found) == {k for k in range(1, 501) if k % 5}
    assert len(list((tmp_path / "files").glob("*/*.json"))) == 500 and len(list((tmp_path / "files").iterdir())) == 100

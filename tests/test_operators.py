import json
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry, raster
from quire.operators import chunking, gate, images, pages, report, strategy, triage, verify, words
from quire.options import Options
from quire.plans import deadline, environment, limits
from quire.sources import readers
from quire.streaming import ingest


def test_gate_fails_open_and_forced(spark):
    table = spark.createDataFrame([(1, 0, 10, 0, 0), (1, 1, 0, 0, 0), (2, 0, 10, 90, 0), (2, 1, None, 5, 0)], "doc_id long, page_index int, content_bytes long, image_bytes long, other_bytes long")
    gated = {(r.doc_id, r.page_index): r for r in gate.gate_pages(gate.score_pages(table, Options())).collect()}
    assert gated[1, 0].route == gated[1, 1].route == "passthrough" and gated[2, 0].route == "process" and gated[2, 1].worthy
    assert all(r.route == "process" for r in gate.gate_pages(gate.score_pages(table, Options(re_ocr=True))).collect())
    assert all(r.worthy for r in gate.score_pages(table, Options(min_image_byte_fraction=0.0)).collect())


def test_page_bytes(spark):
    streams = spark.createDataFrame([(1, 0, "Image", "7"), (1, 0, "Image", "x"), (1, 0, "Form", None), (1, 0, "Content", "3")], "doc_id long, page_index int, kind string, length string")
    assert [tuple(r) for r in gate.page_bytes(streams).collect()] == [(1, 0, 3, 7, 0)]


def test_missing_pages_long_spec(spark):
    pages = spark.range(3).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page_index"))
    assert gate.missing_pages(pages, set(range(2, 1200))).count() == 1196 and gate.select_pages(pages, {2, 9}).count() == 1


def greedy(costs, cap):
    if sum(costs) <= cap or len(costs) <= 1:
        return [1] * len(costs)
    out, size, chunk, empty = [], 0, 1, True
    for cost in costs:
        if not empty and size + cost > cap:
            chunk, size = chunk + 1, 0
        size, empty = size + cost, False
        out.append(chunk)
    return out


def test_chunks(spark):
    docs = {1: [5, 5, 5], 2: [50], 3: [3, 20, 3, 3, 9, 0, 0, 20, 20], 4: [0, 20, 20], 5: [4, 4, 4, 4, 4, 4], 6: [], 7: [11, 11], 8: [4, None, 4, 4, None, 20], 9: [1] * 25_000}
    rows = [(d, i, c) for d, costs in docs.items() for i, c in enumerate(costs)]
    pages = spark.createDataFrame(rows, "doc_id long, page_index int, cost long").repartition(3)
    got = {(r.doc_id, r.page_index): r.chunk_no for r in chunking.assign_chunks(pages, 10).collect()}
    for doc, costs in docs.items():
        assert [got[doc, i] for i in range(len(costs))] == greedy([c or 0 for c in costs], 10), doc
    with pytest.raises(ValueError):
        chunking.assign_chunks(pages, 0)
    assert chunking.assign_chunks(pages.limit(0), 10).count() == 0


def test_policy_precedence(spark):
    rows = [(1, True, True, True, 1, 1, 1.0), (2, False, True, True, 1, 1, 1.0), (3, False, True, False, 99, 1, 1.0), (4, False, False, False, 99, 1, 1.0), (5, False, False, False, 1, 300 << 20, 1.0), (6, False, False, False, 1, 1, 20_000.0), (7, False, False, False, 1, 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id int, is_encrypted boolean, is_signed boolean, is_certified boolean, pages int, bytes long, axis_pt double").withColumn("profile", F.lit("a"))
    decide = lambda o: [r.decision for r in triage.apply_policy(docs, {"a": o}).orderBy("doc_id").collect()]
    assert decide(Options(max_pages=50)) == ["E-INPUT-ENCRYPTED", "E-INPUT-CERTIFIED", "E-INPUT-SIGNED", "E-INPUT-OVERSIZE", "E-INPUT-OVERSIZE", "E-INPUT-DECOMPRESSION-BOMB", "PROCEED"]
    assert decide(Options(max_pages=None, password="x", allow_certified_invalidation=True, preserve_signatures=True))[:4] == ["PROCEED", "PROCEED", "PASSTHROUGH-SIGNED", "PROCEED"]


def test_tree_cycles_and_depth(spark):
    edges = [(1, 0, 1, "Root"), (1, 1, 2, "Names"), (1, 2, 2, "Kids"), (1, 2, 3, "JavaScript")] + [(2, i, i + 1, f"k{i}") for i in range(80)]
    table = spark.createDataFrame(edges, "doc_id long, parent long, child long, key string").withColumn("is_indirect", F.lit(True))
    got = {r.doc_id: r for r in triage.reachable_keys(table).withColumn("f", triage.key_flags(F.col("keys"))).collect()}
    assert set(got[1]["keys"]) == {"Root", "Names", "Kids", "JavaScript"} and got[1].nodes == 3 and got[1].f.has_scripts and not got[1].too_deep
    assert got[2].too_deep and got[2].max_level == 64 and not got[2].f.has_scripts


def test_shared_nodes_are_entered_once(spark):
    """Diamonds, which paths would multiply, and nodes that direct references reach."""
    edges = [(1, 0, 1, "Root", True)]
    for d in range(20):
        top, below = 1 + 3 * d, 4 + 3 * d
        edges += [(1, top, top + 1, "L", True), (1, top, top + 2, "R", True), (1, top + 1, below, "A", True), (1, top + 2, below, f"B{d}", True)]
    edges += [(2, 0, 1, "Root", False), (2, 1, 2, "In", False), (2, 2, 3, "JS", False), (3, 5, 6, "Lost", True), (None, 0, 1, "Root", True), (4, 0, 1, None, True)]
    table = spark.createDataFrame(edges, "doc_id long, parent long, child long, key string, is_indirect boolean").repartition(5)
    got = {r.doc_id: r for r in triage.reachable_keys(table).collect()}
    assert set(got) == {1, 2, None, 4} and (got[1].nodes, got[1].max_level, got[1].too_deep) == (61, 41, False)
    assert len(got[1]["keys"]) == 4 + 20 and got[2]["keys"] == ["In", "JS", "Root"] and got[4]["keys"] == []
    assert triage.reachable_keys(table.limit(0)).count() == 0


def test_many_trees(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(i // 2).cast("long").alias("parent"), F.lit(i).cast("long").alias("child")) for i in range(1, 5)])).alias("e"))
    table = docs.select("doc_id", "e.parent", "e.child", F.lit("k").alias("key"), F.lit(True).alias("is_indirect"))
    assert triage.reachable_keys(table).agg(F.count("*"), F.min("nodes"), F.max("nodes")).first()[:] == (200_000, 4, 4)


def test_page_axes(spark):
    box = ["0", "0", "612", "792"]
    rows = [(1, 0, None, box), (1, 1, [], ["0", "0", "15000", "1"]), (1, 2, ["1", "2", "3", "x"], ["0", "0", "99999", "1"]), (2, 0, box[:3], box), (3, 0, ["nan", "0", "1", "1"], box), (4, 0, ["-14400", "0", "0.5", "0"], box)]
    got = {r.doc_id: (r.axis_pt, r.first_bomb) for r in triage.page_axes(spark.createDataFrame(rows, "doc_id long, page_index int, crop array<string>, media array<string>")).collect()}
    assert got == {1: (15000.0, 2), 2: (None, None), 3: (None, None), 4: (14400.5, 1)}


def test_pages_split_and_merged(spark):
    docs = spark.createDataFrame([(1, ["a", "bb", None, "d"]), (2, []), (3, None), (4, ["only"])], "doc_id long, pages array<string>")
    split = pages.split_pages(docs, {1, 2, 4})
    assert sorted((r.doc_id, r.page_index, r.body, r.input_bytes) for r in split.collect()) == [(1, 0, "a", 1), (1, 1, "bb", 2), (1, 3, "d", 1), (4, 0, "only", 4)]
    assert pages.split_pages(docs).count() == 5
    merged = {r.doc_id: (r.pages, r.page_count, r.error_code) for r in pages.merge_pages(split.repartition(5).filter("doc_id = 1 OR body <> 'only'"), split).collect()}
    assert merged == {1: (["a", "bb", "d"], 3, None), 4: (None, 0, "E-ENGINE-ERROR")}
    twice = {r.doc_id: r.error_code for r in pages.merge_pages(split.unionAll(split.filter("doc_id = 4")), split).collect()}
    assert twice == {1: None, 4: "E-ENGINE-ERROR"}


def test_images(spark, tmp_path):
    sizes = spark.createDataFrame([(1, 0, 8.0, 8.0), (1, 1, 1e6, 1e6), (1, 2, 8.0, 8.0), (2, 0, 0.0, 1.0)], "doc_id long, page_index int, width_pt double, height_pt double")
    rasters = spark.createDataFrame([(1, 0, 2, 2, [0, 255, 300, -5]), (1, 2, 2, 2, [1]), (2, 0, 1, 1, [1])], "doc_id long, page_index int, w int, h int, px array<int>")
    got = {(r.doc_id, r.page_no): r for r in images.export_images(images.plan_images(sizes, "png", 72), rasters).collect()}
    image = bytes(got[1, 1].image)
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(image[41 : 41 + int.from_bytes(image[33:37], "big")]) == bytes([0, 0, 255, 0, 255, 0])
    assert got[1, 2].error == "E-INPUT-DECOMPRESSION-BOMB" and "reshape" in got[1, 3].error and got[2, 1].error == "E-INPUT-CORRUPT" and got[1, 1].name == "doc1_001.png"
    eager = {r.doc_id: (len(r.images), r.failed) for r in images.collected_images(images.export_images(images.plan_images(sizes, "png", 72), rasters)).collect()}
    assert eager == {1: (1, 2), 2: (0, 1)}
    for bad in (("gif", 72), ("png", 0), ("png", 1201)):
        with pytest.raises(ValueError):
            images.plan_images(sizes, *bad)
    with pytest.raises(ValueError, match="width_pt double"):
        images.plan_images(sizes.drop("width_pt"), "png", 72)


def test_slow_pages_are_error_rows(spark):
    def kernel(px):
        if px[0, 0] == 1:
            time.sleep(20)
        return {"x": 1}

    rows = spark.createDataFrame([(1, 1, 1, [1]), (2, 1, 1, [2]), (3, None, 1, [2])], "id int, w int, h int, px array<int>")
    got = {r.id: (r.x, (r.error or "")[:18]) for r in raster.map_rasters(rows, kernel, ["px"], ["id"], "x int", seconds=0.5).collect()}
    assert got == {1: (None, "E-TIMEOUT-PER-PAGE"), 2: (1, ""), 3: (None, "no raster")}


def test_worker_limits(spark):
    assert limits.worker_settings(512 << 20)["spark.executor.pyspark.memory"] == "512m" and "spark.executor.pyspark.memory" not in limits.worker_settings(0)

    def same(batches):
        yield from batches

    assert limits.resident_bytes() > 1 << 20
    assert spark.range(10).mapInArrow(limits.watched(same, 0), "id long").count() == 10
    with pytest.raises(Exception, match="E-MEM-CAP"):
        spark.range(10).mapInArrow(limits.watched(same, 1), "id long").count()


def test_quantiles(spark):
    import numpy as np

    values = {"a": list(range(1000)), "b": [5.0], "c": [1.0, 2.0], None: [3.0, None, 4.0, 8.0]}
    rows = [(g, None if v is None else float(v)) for g, own in values.items() for v in own]
    got = {r.g: (r.low, r.mid, r.high) for r in report.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v", {"low": 0.1, "mid": 0.5, "high": 0.999}).collect()}
    for g, own in values.items():
        assert got[g] == pytest.approx(tuple(np.quantile([v for v in own if v is not None], [0.1, 0.5, 0.999])))


def test_totals_table_with_a_crash(spark):
    rows = spark.createDataFrame([("a", "ok", None, 1000, 500, 1, 2, "pass"), ("b", "crashed", "boom", 10, 0, 0, 0, "")], "label string, status string, reason string, input_bytes long, output_bytes long, pages int, wall_ms int, verifier string")
    lines = [r.line for r in report.totals_table(rows).orderBy("position", "label").collect()]
    assert lines == ["| a | 1,000 | 500 | 2.00x | 1 | 2 | pass |", "| b | 10 | \u2014 | \u2014 | \u2014 | \u2014 | *** CRASH: boom *** |", "1 runs crashed; totals left out"]
    assert report.totals_table(rows.limit(0)).count() == 0


def test_stream_of_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_bytes(name.encode() * 5)

    def analyse(files):
        docs = files.select(F.xxhash64("path").alias("doc_id"), F.lit(False).alias("is_encrypted"), F.lit(False).alias("is_signed"), F.lit(False).alias("is_certified"), F.lit(1).alias("pages"), F.col("length").alias("bytes"), F.lit(10.0).alias("axis_pt"))
        rows = docs.select(
            "doc_id", F.lit(0).alias("page_index"), F.lit(10).alias("content_bytes"), F.lit(90).alias("image_bytes"), F.lit(0).alias("other_bytes"), F.lit(0.5).alias("coverage"), F.lit(0.9).alias("light"), F.lit(False).alias("monochrome"),
            F.lit(20).alias("output_bytes"), F.lit(8).alias("w"), F.lit(8).alias("h"),
        )
        return docs, rows

    run = ingest.run_reports(ingest.stream_documents(spark, str(tmp_path / "in")), analyse, Options(), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out") + "/batch=*").collect()
    assert len(got) == 2 and all((r.status, r.mixed, r.warnings) == ("ok", 1, "page-1-text-only-demoted-to-mixed-color-detected") for r in got)


def test_signature_flags(spark):
    rows = spark.createDataFrame([("3", None), ("x", None), ("2", True), (None, None)], "s string, m boolean")
    assert [tuple(r.f) for r in rows.select(triage.signature_flags(F.col("s"), F.col("m")).alias("f")).collect()] == [(True, False), (False, False), (True, True), (False, False)]


@pytest.mark.parametrize(("coverage", "light", "expected"), [(0.0, 1.0, "photo_only"), (0.15, 0.85, "text_only"), (0.01, 0.2, "photo_only"), (0.2, 0.5, "mixed"), (0.05, 0.95, "photo_only"), (0.95, 0.8, "text_only")])
def test_strategy(spark, coverage, light, expected):
    assert spark.range(1).select(strategy.classify_page(F.lit(coverage), F.lit(light))).first()[0] == expected


def test_verdict_fold(spark):
    schema = "doc_id int, page_index int, lev double, ssim_global double, ssim_tile_min double, digits_match boolean, color_preserved boolean, passed boolean"
    rows = [(1, 1, 0.2, 0.5, 0.4, False, True, False), (1, 0, 0.0, 1.0, 1.0, True, True, True), (2, 0, 0.0, 1.0, 1.0, True, True, True), (3, 0, None, None, None, None, None, False)]
    got = {r.doc_id: r for r in verify.verify_documents(spark.createDataFrame(rows, schema)).withColumn("s", verify.failure_summary()).withColumn("d", verify.drift_decision(Options())).collect()}
    assert (got[1].status, got[1].failing_pages, got[1].ocr_levenshtein, got[1].ssim_global) == ("fail", [1], 0.2, 0.5) and got[1].s.startswith("1/2 pages") and got[1].d.endswith("pages [1]")
    assert got[2].status == "pass" and got[2].s == "" and got[2].d is None
    assert got[3].status == "fail" and (got[3].ocr_levenshtein, got[3].ssim_global) == (1.0, 0.0)
    skipped = verify.skipped_verdicts(spark.createDataFrame(rows, schema)).first()
    assert (skipped.status, skipped.ocr_levenshtein, skipped.ssim_global, skipped.color_preserved) == ("skipped", 1.0, 0.0, False)


def test_missing_measure_fails_page(spark):
    page = spark.createDataFrame([("a", "a", None, 1.0, None, None, 0.05, 0.9, 0.8)], "input_text string, output_text string, ssim_global double, ssim_tile_min double, input_color boolean, output_color boolean, lev_ceiling double, ssim_floor double, tile_floor double")
    assert verify.verify_pages(page).first().passed is False


def test_partition_count_changes_nothing(spark, sf_dir):
    from quire.catalog import pages as queries

    one = sorted(map(tuple, queries.chunk_assign(spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, queries.chunk_assign(spark, sf_dir).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_words(spark):
    glyphs = [(1, 0, "a", 0, 0, 5, 10), (1, 1, "b", 6, 0, 10, 10), (1, 2, " ", 10, 0, 12, 10), (1, 3, "c", 12, 0, 15, 10), (1, 4, "d", 25, 0, 30, 10), (1, 5, "e", 30, 20, 35, 30), (1, 6, " ", 0, 0, 1, 1)]
    rows = spark.createDataFrame([(p, i, c, float(x), float(y), float(r), float(t)) for p, i, c, x, y, r, t in glyphs], "page_id int, i int, ch string, left double, bottom double, right double, top double")
    got = [(r.word_no, r.text, r.left, r.right) for r in words.words(rows).orderBy("word_no").collect()]
    assert got == [(0, "ab", 0.0, 10.0), (1, "c", 12.0, 15.0), (2, "d", 25.0, 30.0), (3, "e", 30.0, 35.0)]


def test_geometry(spark):
    row = spark.range(1).select(geometry.points_to_pixels(F.lit(1.5), F.lit(72)).alias("a"), geometry.points_to_pixels(F.lit(2.5), F.lit(72)).alias("b"), geometry.render_guard(F.lit(0.0), F.lit(5.0), F.lit(72)).alias("c"), geometry.render_guard(F.lit(14_400.0), F.lit(14_400.0), F.lit(300)).alias("d"), geometry.axis_bomb(F.lit(None).cast("double"), F.lit(0.0), F.lit(9e9), F.lit(1.0)).alias("e")).first()
    assert tuple(row) == (2, 2, "invalid", "bomb", False)


def test_ratio_floor_and_json(spark):
    docs = spark.createDataFrame([(1, 100, 90, None), (2, 100, 0, "w")], "doc_id int, input_bytes long, output_bytes long, warning string")
    done = report.apply_ratio_floor(docs, Options()).orderBy("doc_id")
    assert [(r.ratio, r.output_bytes, r.status) for r in done.collect()] == [(1.0, 100, "passed_through"), (100.0, 0, "ok")]
    assert json.loads(done.select(report.as_json(["doc_id", "warning"])).first()[0]) == {"doc_id": 1, "warning": None}
    assert [r.ratio for r in report.apply_ratio_floor(docs, Options(min_ratio=0)).orderBy("doc_id").collect()] == [pytest.approx(100 / 90), 100.0]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", b"aaa"), ("b.pdf", b"b" * 3000), ("c.pdf", b"aaa")):
        (tmp_path / "in" / name).write_bytes(data)
    files = readers.read_documents(spark, str(tmp_path / "in"))
    options = Options(max_input_mb=0.001)
    assert readers.within_size(files, options).count() == 2 and readers.oversize(files, options).count() == 1
    import hashlib

    manifest = {"schema_version": 1, "fixtures": [{"name": "a.pdf", "url": "u", "sha256": hashlib.sha256(b"aaa").hexdigest(), "tags": ["x"]}, {"name": "b.pdf", "url": "u", "sha256": "0", "tags": ["x"]}, {"name": "z.pdf", "url": "u", "sha256": "0", "tags": []}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    rows = readers.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert {r.name: r.state for r in readers.checked(files, rows).collect()} == {"a.pdf": "ok", "b.pdf": "changed", "z.pdf": "missing"}
    assert readers.read_manifest(spark, str(tmp_path / "manifest.json"), "x").count() == 2
    stream = ingest.once_per_content(ingest.stream_documents(spark, str(tmp_path / "in")))
    run = ingest.run_batches(stream, lambda df: df.select("path", "content_sha256"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert run.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out") + "/batch=*").count() == 2


def test_chunk_sink(spark, tmp_path):
    table = spark.createDataFrame([(d, i, 6) for d in (1, 2) for i in range(4)], "doc_id long, page_index int, cost long")
    chunking.write_chunks(chunking.assign_chunks(table, 12), str(tmp_path / "c"), 12)
    got = {}
    for r in chunking.read_chunks(spark, str(tmp_path / "c")).collect():
        got.setdefault((r.doc_id, r.name), set()).add((r.page_index, r.file))
    assert {k: {p for p, _ in v} for k, v in got.items()} == {(d, f"doc{d}_00{c}.pdf"): {2 * c - 2, 2 * c - 1} for d in (1, 2) for c in (1, 2)}
    assert all(len({f for _, f in v}) == 1 for v in got.values())


def test_many_chunks(spark, tmp_path):
    """A file of its name for each of 3000 chunks; a second run replaces the first; 23 ms a chunk on the driver would be too slow."""
    table = spark.range(3000).selectExpr("id DIV 2 AS doc_id", "CAST(id % 2 AS INT) AS page_index", "CAST(20 AS BIGINT) AS cost")
    path, began = str(tmp_path / "c"), time.monotonic()
    chunking.write_chunks(chunking.assign_chunks(table.limit(4), 12), path, 12, "old")
    chunking.write_chunks(chunking.assign_chunks(table, 12), path, 12)
    got = chunking.read_chunks(spark, path).collect()
    assert time.monotonic() - began < 30
    names = {f"doc{d}_00{c}.pdf" for d in range(1500) for c in (1, 2)}
    assert {p.name for p in (tmp_path / "c").iterdir() if not p.name.startswith("_")} == names and all((tmp_path / "c" / n).is_file() for n in names)
    assert {r.name for r in got} == names and len(got) == 3000 and all(r.file.endswith("/" + r.name) and r.page_index == r.chunk_no - 1 for r in got)
    chunking.write_chunks(chunking.assign_chunks(table.limit(0), 12), path, 12)
    assert chunking.read_chunks(spark, path).collect() == []


def test_build_info(spark):
    rows = spark.createDataFrame([('{"version": "1.2", "git_sha": "unknown"}',), ("nonsense",), (None,)], "r string")
    got = [tuple(r.b) for r in rows.select(readers.build_info(F.col("r")).alias("b")).collect()]
    assert got == [("1.2", "?", "?", "?"), ("?",) * 4, ("?",) * 4]


def test_environment_and_deadline(spark):
    assert environment.environment_report(spark).filter("NOT ok").isEmpty()
    assert deadline.within(spark, 60, lambda: spark.range(10).count()) == 10
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    with pytest.raises(TimeoutError):
        deadline.within(spark, 2, lambda: spark.range(8).select(slow("id").alias("x")).agg(F.sum("x")).collect())

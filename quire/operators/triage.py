"""Structural triage of inputs, and the ordered policy that follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.geometry import axis_bomb, box_axis
from quire.options import AXIS_CAP_PT, EXIT_CODES, MEBIBYTE, Options

#: Dictionary keys that flag scripts and attachments, and the walk's depth.
SCRIPT_KEYS = ("JavaScript", "JS")
ATTACHMENT_KEYS = ("EmbeddedFiles", "EmbeddedFile")
MAX_DEPTH = 64


def is_linearized(content: Column) -> Column:
    """The linearization entry within the first 1024 bytes (F1); text or binary."""
    return F.coalesce(F.substr(content, F.lit(1), F.lit(1024)).cast("string").rlike(r"/Linearized\s+[0-9.]+"), F.lit(False))


def signature_flags(sig_flags: Column, has_doc_mdp: Column) -> Column:
    """(is_signed, is_certified): bit 1 of the flags; certified implies signed; an unreadable number is no flag."""
    certified = F.coalesce(has_doc_mdp, F.lit(False))
    bit = F.coalesce(sig_flags.try_cast("int").bitwiseAND(1) == 1, F.lit(False))
    return F.struct((bit | certified).alias("is_signed"), certified.alias("is_certified"))


def has_filter(filters: Column, name: str = "/JBIG2Decode") -> Column:
    """Whether a stream's filter list has ``name``."""
    return F.coalesce(F.array_contains(filters, name), F.lit(False))


def is_archival(xmp: Column) -> Column:
    return F.coalesce(xmp.contains("pdfaid:part"), F.lit(False))


def is_tagged(marked: Column, has_structure: Column) -> Column:
    return F.coalesce(marked, F.lit(False)) | F.coalesce(has_structure, F.lit(False))


def classify(is_encrypted: Column, is_certified: Column, is_signed: Column) -> Column:
    """The class of an input: encryption first, then any signature."""
    return F.when(is_encrypted, "require-password").when(is_certified | is_signed, "refuse").otherwise("proceed")


def triage(docs: DataFrame) -> DataFrame:
    """A triage row for each row of ingest columns.

    ``docs`` has doc_id, bytes, head, pages, is_encrypted, password_ok, parse_ok,
    sig_flags, has_doc_mdp, xmp, marked, has_structure, producer. Where the
    password fails the rest is unknown and the row says so with 0 pages; an input
    that can't be parsed is a row with an error code. Nothing is raised.
    """
    flags = signature_flags(F.col("sig_flags"), F.col("has_doc_mdp"))
    locked = F.col("is_encrypted") & ~F.coalesce(F.col("password_ok"), F.lit(False))
    known = F.col("parse_ok") & ~locked
    shown = lambda c: known & c
    rows = docs.withColumn("__f", flags)
    signed, certified = shown(F.col("__f.is_signed")), shown(F.col("__f.is_certified"))
    return rows.select(
        "doc_id", "bytes",
        F.when(known, F.col("pages")).otherwise(0).alias("pages"),
        F.col("is_encrypted"), signed.alias("is_signed"), certified.alias("is_certified"),
        is_linearized(F.col("head")).alias("is_linearized"),
        shown(is_archival(F.col("xmp"))).alias("is_archival"),
        shown(is_tagged(F.col("marked"), F.col("has_structure"))).alias("is_tagged"),
        F.when(known, F.col("producer")).alias("producer"),
        F.when(~F.col("parse_ok"), "E-INPUT-CORRUPT").alias("error_code"),
        classify(locked, certified, signed).alias("classification"),
    )


def reachable_keys(edges: DataFrame, root: int = 1, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, keys, nodes, max_level, too_deep): keys met on a walk from ``root`` (F2).

    ``edges`` is (doc_id, parent, child, key, is_indirect). The walk goes level by
    level and enters a node that can be referred to (``is_indirect``) once, so shared and circular references cost
    nothing; the key that leads to it counts each time. Other nodes stand in one
    place by nature; should they not, a level enters each of them once. A walk
    that would pass ``max_depth`` is flagged instead of followed. A document
    without an edge to the root has no row.

    Rows are dealt and sorted by document in one shuffle; a task holds the edges
    of one document at a time, which the size limit of inputs bounds.
    """
    ordered = edges.select("doc_id", "parent", "child", "key", "is_indirect").repartition("doc_id").sortWithinPartitions("doc_id")
    id_type = edges.schema["doc_id"].dataType.simpleString()

    def walk(batches):
        import pyarrow as pa

        names = ["doc_id", "keys", "nodes", "max_level", "too_deep"]
        types = [None, pa.list_(pa.string()), pa.int64(), pa.int32(), pa.bool_()]
        doc, own, begun = None, {}, False
        for batch in batches:
            done = []
            for key, *edge in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if begun and key != doc:
                    done.append((doc, *_walk(own, root, max_depth)))
                    own = {}
                doc, begun = key, True
                own.setdefault(edge[0], []).append(edge[1:])
            found = [r for r in done if r[2]]
            types[0] = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names)
        if begun and (last := (doc, *_walk(own, root, max_depth)))[2]:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, types, strict=True)], names)

    return ordered.mapInArrow(walk, f"doc_id {id_type}, keys array<string>, nodes long, max_level int, too_deep boolean")


def _walk(children: dict, root: int, max_depth: int) -> tuple[list[str], int, int, bool]:
    """Sorted keys, nodes entered, deepest level and whether there is more below, of one document's walk.

    ``children`` has each parent's (child, key, is_indirect); the root hangs below any parent.
    """
    visited, keys, nodes, deepest, too_deep = set(), set(), 0, 0, False
    level, due = 1, [e for edges in children.values() for e in edges if e[0] == root]
    while due:
        entered = set()
        for child, key, indirect in due:
            if child in visited or child in entered:
                new = False
            else:
                new = True
            if level > max_depth:
                too_deep = too_deep or new
                continue
            deepest = level
            if key is not None:
                keys.add(key)
            if new:
                entered.add(child)
                nodes += 1
                if indirect:
                    visited.add(child)
        due = [e for node in entered for e in children.get(node, ())]
        level += 1
        if level > max_depth + 1:
            break
    return sorted(keys), nodes, deepest, too_deep


def key_flags(keys: Column) -> Column:
    """(has_scripts, has_attachments) from a document's keys."""
    any_of = lambda names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    return F.struct(any_of(SCRIPT_KEYS).alias("has_scripts"), any_of(ATTACHMENT_KEYS).alias("has_attachments"))


def page_axes(pages: DataFrame) -> DataFrame:
    """(doc_id, axis_pt, first_bomb): the longest side of a document's page boxes, and the first page over the cap.

    ``pages`` has doc_id, page_index and the boxes crop and media as arrays of
    strings or numbers. A page's box is its crop box, else its media box; one with
    fewer than four numbers is skipped. Partial maxima are combined before the shuffle.
    """
    sides = pages.select("doc_id", "page_index", box_axis(F.coalesce(F.when(F.size("crop") > 0, F.col("crop")), F.col("media"))).alias("axis"))
    return sides.groupBy("doc_id").agg(F.max("axis").alias("axis_pt"), (F.min(F.when(F.col("axis") > AXIS_CAP_PT, F.col("page_index"))) + 1).alias("first_bomb"))


def option_table(spark: SparkSession, profiles: dict[str, Options]) -> DataFrame:
    """Options that may differ by profile, one row each: a table to join."""
    rows = [
        (name, o.password is not None, o.allow_certified_invalidation, o.allow_signed_invalidation, o.preserve_signatures, o.max_pages, o.max_input_mb, o.min_input_mb)
        for name, o in profiles.items()
    ]
    fields = "profile string, has_password boolean, allow_certified boolean, allow_signed boolean, preserve boolean, max_pages int, max_mb double, min_mb double"
    return spark.createDataFrame(rows, fields)


def policy_decision() -> Column:
    """The first gate that decides, over triage and option columns.

    Encryption without a password, a certifying signature, another signature,
    pages, size, page axes (``axis_pt`` is the longest side of a page's box, see ``page_axes``); then inputs too small to bother with pass through.
    """
    mb = F.col("bytes") / MEBIBYTE
    plainly_signed = F.col("is_signed") & ~F.col("is_certified")
    return (
        F.when(F.col("is_encrypted") & ~F.col("has_password"), "E-INPUT-ENCRYPTED")
        .when(F.col("is_certified") & ~F.col("allow_certified"), "E-INPUT-CERTIFIED")
        .when(plainly_signed & F.col("preserve"), "PASSTHROUGH-SIGNED")
        .when(plainly_signed & ~F.col("allow_signed"), "E-INPUT-SIGNED")
        .when(F.col("pages") > F.col("max_pages"), "E-INPUT-OVERSIZE")
        .when(mb > F.col("max_mb"), "E-INPUT-OVERSIZE")
        .when(axis_bomb(F.lit(0.0), F.lit(0.0), F.col("axis_pt"), F.lit(792.0)), "E-INPUT-DECOMPRESSION-BOMB")
        .when((F.col("min_mb") > 0) & (mb < F.col("min_mb")), "PASSTHROUGH-SMALL")
        .otherwise("PROCEED")
    )


def exit_code(decision: Column) -> Column:
    """The process exit code of a decision (X8); what passes through or proceeds ends with 0."""
    table = F.create_map(*[F.lit(x) for code, (number, _) in EXIT_CODES.items() for x in (code, number)])
    return F.coalesce(F.try_element_at(table, decision), F.lit(0))


def apply_policy(triaged: DataFrame, profiles: dict[str, Options]) -> DataFrame:
    """``triaged`` with decision and exit_code; options come by ``profile``, a table of a few rows."""
    options = F.broadcast(option_table(triaged.sparkSession, profiles))
    return triaged.join(options, "profile").withColumn("decision", policy_decision()).withColumn("exit_code", exit_code(F.col("decision")))


def signature_outcome(is_signed: Column, is_certified: Column, options: Options) -> Column:
    """What became of a signature."""
    return (
        F.when(is_certified & F.lit(options.allow_certified_invalidation), "certified-invalidated-allowed")
        .when(is_signed & F.lit(options.allow_signed_invalidation), "invalidated-allowed")
        .otherwise("none")
    )

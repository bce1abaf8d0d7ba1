"""Files to chunks to the index: S2, S3, S5, S12, J1 to J4, W6, R1, B1 to B3, B5."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from checks import query
from checks.scalars import most_hits_sql, strip_sql
from checks.tables import FILES_SQL, documents, files, table, with_ctes
from lectern.config import DEFAULTS, Settings
from lectern.functions import language, text
from lectern.functions.vectors import embed, has_length
from lectern.operators.chunks import explode_chunks, with_chunk_id
from lectern.plans import lake
from lectern.schemas import CHUNK_INDEX, GOLD, conform
from lectern.session import shared_folder, stored_table
from lectern.sources import changes
from lectern.sources.landing import extract_documents
from lectern.sources.layers import publish, read_layer, scan_corpus, write_increment
from lectern.sources.upsert import replace_documents, upsert

SMALL = Settings(chunk_size=300, chunk_overlap=50)


# ---- the chunker in SQL ------------------------------------------------------------------


def pack_sql(expr: str, size: int, separators: tuple[str, ...], depth: int = 0) -> str:
    """Greedy packing as nested list folds: the same result, written for DuckDB."""
    if not separators:
        return (
            f"list_transform(range(1, length({expr}) + 1, {size}), "
            f"lambda z: substring({expr}, z, {size}))"
        )
    sep = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in separators[0])
    n, a, x, p = len(separators[0]), f"a{depth}", f"x{depth}", f"p{depth}"
    none = "CAST([] AS VARCHAR[])"
    closed = f"CASE WHEN {a}.o <> '' THEN list_append({a}.d, {a}.o) ELSE {a}.d END"
    joined = f"length({a}.o) + CASE WHEN {a}.o <> '' THEN {n} ELSE 0 END + length({x}.o)"
    glued = f"CASE WHEN {a}.o <> '' THEN {a}.o || {sep} || {x}.o ELSE {x}.o END"
    finer = pack_sql(f"{x}.o", size, separators[1:], depth + 1)
    step = (
        f"CASE WHEN {joined} <= {size} THEN {{'d': {a}.d, 'o': {glued}}} "
        f"WHEN length({x}.o) > {size} THEN {{'d': list_concat({closed}, {finer}), 'o': ''}} "
        f"ELSE {{'d': {closed}, 'o': {x}.o}} END"
    )
    parts = f"list_transform(string_split({expr}, {sep}), lambda {p}: {{'d': {none}, 'o': {p}}})"
    folded = f"list_reduce(list_prepend({{'d': {none}, 'o': ''}}, {parts}), lambda {a}, {x}: {step})"
    done = f"f{depth}"
    return (
        f"list_transform([{folded}], lambda {done}: CASE WHEN {done}.o <> '' "
        f"THEN list_append({done}.d, {done}.o) ELSE {done}.d END)[1]"
    )


def chunks_sql(source: str, key: str, body: str, settings: Settings) -> str:
    """CTEs `raw` (raw chunks as a list) and `chunks` (one row per kept chunk)."""
    overlapped = strip_sql(
        f"CASE WHEN i > 1 THEN concat(right(raw[i - 1], {settings.chunk_overlap}), ' ', raw[i]) ELSE raw[i] END"
    )
    return f"""raw AS (SELECT {key}, {pack_sql(body, settings.chunk_size, text.SEPARATORS)} AS raw FROM {source}),
numbered AS (SELECT {key}, raw, unnest(range(1, len(raw) + 1)) AS i FROM raw),
kept AS (SELECT {key}, i, {overlapped} AS chunk_text FROM numbered),
chunks AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS INTEGER) AS chunk_pos, chunk_text
           FROM kept WHERE length(chunk_text) > {settings.min_chunk_chars})"""


def raw_chunk_sql(size: int) -> str:
    body = pack_sql("text", size, text.SEPARATORS)
    return (
        f"WITH c AS (SELECT doc_id, {body} AS c FROM documents) SELECT doc_id, len(c) AS chunks, "
        "list_max(list_transform(c, lambda x: length(x))) AS longest, md5(array_to_string(c, '|')) AS digest FROM c"
    )


def raw_chunks(spark, sf_dir, size):
    cut = documents(spark, sf_dir).select("doc_id", text.recursive_chunk(F.col("text"), size).alias("c"))
    return cut.select(
        "doc_id",
        F.size("c").alias("chunks"),
        F.array_max(F.transform("c", lambda x: F.length(x))).alias("longest"),
        F.md5(F.array_join("c", "|")).alias("digest"),
    )


@query("recursive_chunk_300", raw_chunk_sql(300))
def recursive_chunk_300(spark, sf_dir):
    return raw_chunks(spark, sf_dir, 300)


@query("recursive_chunk_2000", raw_chunk_sql(2000))
def recursive_chunk_2000(spark, sf_dir):
    return raw_chunks(spark, sf_dir, 2000)


@query(
    "explode_chunks",
    f"WITH {chunks_sql('documents', 'doc_id', 'text', SMALL)} SELECT doc_id, chunk_pos, chunk_text FROM chunks",
)
def exploded(spark, sf_dir):
    rows = explode_chunks(documents(spark, sf_dir).select("doc_id", "text"), "text", SMALL)
    return rows.select("doc_id", "chunk_pos", "chunk_text")


@query(
    "chunk_ids",
    f"WITH {chunks_sql('documents', 'doc_id', 'text', SMALL)} "
    "SELECT doc_id, chunk_pos, md5(chunk_text) AS digest, 1::BIGINT AS holders, TRUE AS again FROM chunks",
)
def chunk_ids(spark, sf_dir):
    """Every chunk with the number of chunks of its id, and whether a second run gives the same id."""
    rows = explode_chunks(documents(spark, sf_dir).select("doc_id", "text"), "text", SMALL)
    first = with_chunk_id(rows, "doc_id")
    second = with_chunk_id(rows.repartition(3), "doc_id").select("doc_id", "chunk_pos", F.col("chunk_id").alias("second"))
    holders = first.groupBy("chunk_id").agg(F.count("*").alias("holders"))
    return first.join(second, ["doc_id", "chunk_pos"]).join(holders, "chunk_id").select(
        "doc_id", "chunk_pos", F.md5("chunk_text").alias("digest"), "holders", (F.col("chunk_id") == F.col("second")).alias("again")
    )


# ---- layers ------------------------------------------------------------------------------

STEM = r"string_split(regexp_replace(filename, '^(.+)\.[^.]+$', '\1'), '_')"
SILVER_SQL = f"""
SELECT doc_id, filename, raw_text,
  coalesce(nullif(trim({STEM}[1]), ''), 'Unknown') AS professor,
  CASE WHEN coalesce(trim({STEM}[2]), '') = '' THEN {most_hits_sql(strip_sql('substring(raw_text, 1, 800)'), language.SUBJECT_WORDS, 'Unknown')}
       ELSE trim({STEM}[2]) END AS subject,
  coalesce(nullif(trim({STEM}[3]), ''), 'Unknown') AS chapter,
  {most_hits_sql(strip_sql('substring(raw_text, 1, 500)'), language.STOP_WORDS, 'unknown')} AS language,
  len(string_split_regex(raw_text, '\\s+')) AS word_count,
  CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.pptx' THEN 'pptx' ELSE 'unknown' END AS doc_type
FROM files"""
SILVER_COLUMNS = "professor, subject, chapter, language, word_count, doc_type"


@query(
    "build_silver",
    with_ctes(f"SELECT doc_id, {SILVER_COLUMNS} FROM silver", files=FILES_SQL, silver=SILVER_SQL),
)
def build_silver(spark, sf_dir):
    silver = lake.build_silver(files(spark, sf_dir))
    return silver.select("doc_id", *SILVER_COLUMNS.split(", "))


@query(
    "build_gold",
    with_ctes(
        f""", {chunks_sql('files', 'doc_id', 'raw_text', DEFAULTS)}
SELECT c.doc_id, c.chunk_pos, md5(c.chunk_text) AS digest, s.subject, s.language, 64 AS dim, TRUE AS embed_ok
FROM chunks c JOIN silver s USING (doc_id)""",
        files=FILES_SQL,
        silver=SILVER_SQL,
    ),
)
def build_gold(spark, sf_dir):
    gold = lake.build_gold(lake.build_silver(files(spark, sf_dir)))
    return gold.select(
        "doc_id", "chunk_pos", F.md5("chunk_text").alias("digest"), "subject", "language",
        F.size("embedding").alias("dim"), "embed_ok",
    )


# The default embedder in SQL: the MD5 of a word gives its dimension and its sign.
def word_place_sql(word: str, dim: int = DEFAULTS.embed_dim) -> str:
    return (
        f"CAST('0x' || substr(md5({word}), 1, 4) AS INTEGER) % {dim} AS dim, "
        f"CASE WHEN CAST('0x' || substr(md5({word}), 5, 1) AS INTEGER) < 8 THEN 1 ELSE -1 END AS sign"
    )


@query(
    "embed",
    f"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents),
p AS (SELECT doc_id, {word_place_sql('w')} FROM w WHERE w <> ''),
v AS (SELECT doc_id, dim, sum(sign) AS x FROM p GROUP BY doc_id, dim)
SELECT d.doc_id, coalesce(CAST(sum(abs(v.x)) AS DOUBLE), 0) AS weight, coalesce(CAST(sum(v.x * (v.dim + 1)) AS DOUBLE), 0) AS moment,
       coalesce(sum(v.x * v.x) > 0, FALSE) AS embed_ok
FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def embedded(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", embed(F.col("text")).alias("e"))
    moment = F.aggregate(
        F.transform("e", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    weight = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x).cast("double"))
    return rows.select("doc_id", weight.alias("weight"), moment.alias("moment"), has_length(F.col("e")).alias("embed_ok"))


@query("scan_corpus", "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 0")
def corpus(spark, sf_dir):
    rows = scan_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.length("text").alias("chars"))


# ---- presentations -----------------------------------------------------------------------

_SLIDE = (
    '<p:sld xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><p:cSld><p:spTree>{}'
    "</p:spTree></p:cSld></p:sld>"
)
_SHAPE = "<p:sp><p:txBody><a:p>{}</a:p></p:txBody></p:sp>"
_RUN = "<a:r><a:t>{}</a:t></a:r>"
_BEFORE, _AFTER = _SHAPE.format(_RUN).split("{}")
_BETWEEN = _AFTER + _BEFORE
_DECK = (
    '<p:presentation xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    "<p:sldIdLst>{}</p:sldIdLst></p:presentation>"
)
_LINKS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}'
    "</Relationships>"
)


def presentation(slides: list[list[str]]) -> bytes:
    """A minimal presentation package: one shape per line of a slide."""
    members, ids, links = [], [], []
    for i, lines in enumerate(slides, 1):
        shapes = _BETWEEN.join(map(escape, lines))
        members.append((f"ppt/slides/slide{i}.xml", _SLIDE.format(f"{_BEFORE}{shapes}{_AFTER}" if lines else "")))
        ids.append(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>')
        links.append(f'<Relationship Id="rId{i}" Target="slides/slide{i}.xml"/>')
    members.append(("ppt/presentation.xml", _DECK.format("".join(ids))))
    members.append(("ppt/_rels/presentation.xml.rels", _LINKS.format("".join(links))))
    return _stored(members)


def _stored(members: list[tuple[str, str]]) -> bytes:
    """A package of uncompressed files, all of 1980-01-01; very many or large ones are left to the library."""
    if len(members) >= 0xFFFF or sum(len(text) for _, text in members) > 1 << 28:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as package:
            for name, text in members:
                package.writestr(name, text)
        return out.getvalue()
    body, listed, at = [], [], 0
    for name, text in members:
        path, data = name.encode(), text.encode()
        # version, flags, method, time, date, checksum, sizes, length of the name and of further fields
        facts = struct.pack("<HHHHHLLLHH", 20, 0, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(path), 0)
        body += [b"PK\x03\x04", facts, path, data]
        listed.append(b"PK\x01\x02\x14\x03" + facts + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + path)
        at += 30 + len(path) + len(data)
    directory = b"".join(listed)
    end = struct.pack("<HHHHLLH", 0, 0, len(members), len(members), len(directory), at, 0)
    return b"".join([*body, directory, b"PK\x05\x06", end])


def as_presentations(rows):
    """Documents as presentation files: every line of a text is a slide with its sentences."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # the files are larger than their texts
                piece = batch.iloc[at : at + 256]
                content = [
                    presentation([line.split(". ") for line in body.split("\n")])
                    for body in piece["text"]
                ]
                yield pd.DataFrame({"path": piece["path"], "content": content})

    named = rows.select(
        F.concat(F.lit("landing/"), F.col("doc_id").cast("string"), F.lit("/deck.PPTX")).alias("path"),
        F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", "").alias("text"),
    )
    return named.mapInPandas(build, "path string, content binary")


SLIDE_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i
  FROM (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g') AS t FROM documents)),
slides AS (SELECT doc_id, i, array_to_string(list_filter(list_transform(string_split(line, '. '), lambda s: """ + strip_sql("s") + r"""), lambda s: s <> ''), chr(10)) AS body FROM lines)
SELECT concat('landing/', doc_id, '/deck.PPTX') AS path, 'deck.PPTX' AS filename,
  md5(string_agg(concat('[Slide ', i, ']', chr(10), body), chr(10) || chr(10) ORDER BY i) FILTER (WHERE body <> '')) AS digest,
  NULL AS error
FROM slides GROUP BY doc_id"""


@query("extract_presentations", SLIDE_SQL)
def extract_presentations(spark, sf_dir):
    read = extract_documents(as_presentations(documents(spark, sf_dir)))
    return read.select("path", "filename", F.md5("raw_text").alias("digest"), "error")


def slide_text_sql() -> str:
    """Documents as the text of their presentation, named the way the pipeline names them."""
    head, tail = SLIDE_SQL.rsplit("SELECT concat(", 1)
    return head + (
        "SELECT doc_id, string_agg(concat('[Slide ', i, ']', chr(10), body), chr(10) || chr(10) ORDER BY i) "
        "FILTER (WHERE body <> '') AS raw_text FROM slides GROUP BY doc_id"
    )


@query(
    "run_layers",
    with_ctes(
        f""", {chunks_sql('decks', 'doc_id', "coalesce(raw_text, '')", DEFAULTS)}
SELECT concat('landing/', c.doc_id, '/deck.PPTX') AS path, c.chunk_pos, md5(c.chunk_text) AS digest, 'deck' AS professor,
  {most_hits_sql(strip_sql('substring(d.raw_text, 1, 800)'), language.SUBJECT_WORDS, 'Unknown')} AS subject,
  {most_hits_sql(strip_sql('substring(d.raw_text, 1, 500)'), language.STOP_WORDS, 'unknown')} AS language,
  len(string_split_regex(d.raw_text, '\\s+')) AS word_count
FROM chunks c JOIN decks d USING (doc_id)""",
        decks=slide_text_sql(),
    ),
)
def run_layers(spark, sf_dir):
    paths = lake.LakePaths.under(shared_folder(spark))
    lake.run_layers(as_presentations(documents(spark, sf_dir)), paths)
    gold = read_layer(spark, paths.gold, GOLD)
    return gold.select(
        "path", "chunk_pos", F.md5("chunk_text").alias("digest"), "professor", "subject", "language", "word_count"
    )


CHANGES_SQL = """
WITH old AS (SELECT concat('landing/', doc_id) AS path, sha256(text) AS sha FROM documents),
now AS (
  SELECT concat(CASE WHEN doc_id % 7 = 1 THEN 'moved/' ELSE 'landing/' END, doc_id) AS path,
    sha256(CASE WHEN doc_id % 7 = 2 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT concat('copies/', doc_id), sha256(text) FROM documents WHERE doc_id % 7 = 3),
come AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY path) AS no FROM now WHERE path NOT IN (SELECT path FROM old)),
gone AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY path) AS no FROM old WHERE path NOT IN (SELECT path FROM now))
SELECT n.path, 'changed' AS kind, n.sha AS sha256, NULL AS was FROM now n JOIN old o ON o.path = n.path WHERE o.sha <> n.sha
UNION ALL
SELECT coalesce(c.path, g.path), CASE WHEN c.path IS NULL THEN 'vanished' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END,
  coalesce(c.sha, g.sha), CASE WHEN c.path IS NOT NULL THEN g.path END
FROM come c FULL JOIN gone g ON g.sha = c.sha AND g.no = c.no"""


def landed(rows, folder, hour: int):
    """Documents as a listing of files."""
    return rows.select(
        F.concat(folder, F.col("doc_id").cast("string")).alias("path"),
        F.timestamp_seconds(F.lit(1704067200 + 3600 * hour)).alias("modificationTime"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").cast("binary").alias("content"),
    )


@query("scan_changes", CHANGES_SQL)
def scan_landing_changes(spark, sf_dir):
    """All files are taken in; then some vanish, some move, some have other content, and some are copied."""
    docs = documents(spark, sf_dir)
    nothing = spark.createDataFrame([], changes.MANIFEST)
    manifest = stored_table(changes.current_files(landed(docs, F.lit("landing/"), 0), nothing))
    rest = F.pmod("doc_id", F.lit(7))
    text = F.when(rest == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    folder = F.when(rest == 1, "moved/").otherwise("landing/")
    later = landed(docs.filter(rest != 0).withColumn("text", text), folder, 1)
    later = later.unionByName(landed(docs.filter(rest == 3), F.lit("copies/"), 1))
    now = stored_table(changes.current_files(later, manifest))
    return changes.scan_changes(now, manifest)


# ---- index -------------------------------------------------------------------------------


def index_of(rows, hours: int):
    """Documents as index rows loaded `hours` after the first load."""
    shaped = rows.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat_ws("_", "source", "lang").alias("path"),
        F.col("text").alias("document"),
        F.timestamp_seconds(F.lit(1704067200 + hours * 3600)).alias("load_ts"),
    )
    return conform(shaped, CHUNK_INDEX)


INDEX_CTES = {
    "old": "SELECT doc_id AS chunk_id, concat(source, '_', lang) AS path, text AS document, 0 AS h FROM documents",
    "new": "SELECT doc_id AS chunk_id, concat(source, '_', lang) AS path, concat('v1 ', text) AS document, 1 AS h FROM documents WHERE lang = 'fr' "
    "UNION ALL SELECT doc_id, concat(source, '_', lang), concat('v2 ', text), 2 FROM documents WHERE lang = 'fr' AND n_chars < 2000",
    "newest": "SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY h DESC) = 1",
    "newest_load": "SELECT * FROM new QUALIFY h = max(h) OVER (PARTITION BY path)",
}


def loads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    french = docs.filter(F.col("lang") == "fr")
    new = index_of(french.withColumn("text", F.concat(F.lit("v1 "), "text")), 1).unionByName(
        index_of(french.filter("n_chars < 2000").withColumn("text", F.concat(F.lit("v2 "), "text")), 2)
    )
    return index_of(docs, 0), new


@query(
    "upsert_chunks",
    with_ctes(
        "SELECT chunk_id, path, md5(document) AS digest FROM (SELECT * FROM newest UNION ALL "
        "SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new))",
        **INDEX_CTES,
    ),
)
def upsert_chunks(spark, sf_dir):
    old, new = loads(spark, sf_dir)
    merged = upsert(old, new, ["chunk_id"])
    return merged.select("chunk_id", "path", F.md5("document").alias("digest"))


@query(
    "replace_documents",
    with_ctes(
        "SELECT chunk_id, path, md5(document) AS digest FROM (SELECT * FROM newest_load UNION ALL "
        "SELECT * FROM old WHERE path NOT IN (SELECT path FROM new))",
        **INDEX_CTES,
    ),
)
def replaced(spark, sf_dir):
    old, new = loads(spark, sf_dir)
    merged = replace_documents(old, new)
    return merged.select("chunk_id", "path", F.md5("document").alias("digest"))


INDEX_LOAD_SQL = with_ctes(
    f""", {chunks_sql('files', 'doc_id', 'raw_text', SMALL)},
again AS (SELECT doc_id, chunk_pos, chunk_text FROM chunks JOIN files USING (doc_id) WHERE lang <> 'fr')
SELECT concat('landing/', doc_id) AS path, md5(string_agg(chunk_text, '|' ORDER BY chunk_pos)) AS digest, count(*) AS chunks
FROM again GROUP BY doc_id""",
    files=FILES_SQL,
)


@query("index_load", INDEX_LOAD_SQL)
def index_load(spark, sf_dir):
    """All documents are loaded; then the French ones come again, emptied, and lose their chunks."""
    return load_twice(spark, sf_dir, lake.read_index)


@query("index_load_filtered", INDEX_LOAD_SQL)
def index_load_filtered(spark, sf_dir):
    """Both loads are folded into versions; the second reads the files whose filters know one of its documents."""
    return load_twice(spark, sf_dir, lake.compact_index)


def load_twice(spark, sf_dir, read):
    index = f"{shared_folder(spark)}/index"
    silver = lake.build_silver(files(spark, sf_dir))
    gold = lake.build_gold(silver, settings=SMALL)
    lake.index_load(spark, gold, index)
    read(spark, index)
    french = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(
        F.concat(F.lit("landing/"), F.col("doc_id").cast("string")).alias("path")
    )
    emptied = french.withColumns(
        {"chunk_id": F.xxhash64("path"), "document": F.lit(""), "load_ts": F.current_timestamp() + F.expr("INTERVAL 1 HOUR")}
    )
    emptied = conform(emptied, CHUNK_INDEX)
    write_increment(emptied, index, 0)
    rows = read(spark, index).filter(F.length("document") > 0).join(
        gold.select("chunk_id", "chunk_pos"), "chunk_id"
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk_pos", "document")))
    return rows.groupBy("path").agg(
        F.md5(F.array_join(F.transform(ordered, lambda x: x["document"]), "|")).alias("digest"),
        F.count("*").alias("chunks"),
    )


LOADED_SQL = (
    "SELECT path, md5(string_agg(document, '|' ORDER BY chunk_id)) AS digest, count(*) AS chunks FROM "
    "({}) GROUP BY path"
)


def _index_digest(rows):
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "document")))
    return rows.groupBy("path").agg(
        F.md5(F.array_join(F.transform(ordered, lambda x: x["document"]), "|")).alias("digest"), F.count("*").alias("chunks")
    )


@query(
    "index_newer_batch_load",
    with_ctes(LOADED_SQL.format("SELECT * FROM newest_load UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)"), **INDEX_CTES),
)
def index_newer_batch_load(spark, sf_dir):
    """A version, a streamed increment, then newer loads as a batch: the newest load of a document wins."""
    index = f"{shared_folder(spark)}/index"
    old, new = loads(spark, sf_dir)
    publish(old, index)
    write_increment(new.filter("load_ts = timestamp_seconds(1704070800)"), index, 0)
    write_increment(new.filter("load_ts > timestamp_seconds(1704070800)"), index, 0, source="load-later")
    return _index_digest(lake.read_index(spark, index))


@query(
    "index_load_again",
    with_ctes(LOADED_SQL.format("SELECT * FROM newest_load UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)"), **INDEX_CTES),
)
def index_load_again(spark, sf_dir):
    """Two loads of a document in one increment, run twice, between an older load; then all are folded."""
    index = f"{shared_folder(spark)}/index"
    old, new = loads(spark, sf_dir)
    write_increment(new, index, 0)
    write_increment(old, index, 0, source="load-older")
    write_increment(new, index, 0)
    return _index_digest(lake.compact_index(spark, index))

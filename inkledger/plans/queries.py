"""The queries over rendered ledgers, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import semantics as S
from inkledger.operators import extraction as E
from inkledger.operators import fusion, records, scoring
from inkledger.plans.lineage import checkpoint
from inkledger.sources.render import readings, truth_rows

ENGINES = ("tesseract", "easyocr", "fused")


def render_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(truth_rows(spark, sf_dir))


def line_split(spark, sf_dir):
    lines = render_ledgers(spark, sf_dir).select("stem", "engine", F.posexplode(S.lines_of(F.col("text"))).alias("line_pos", "line"))
    return lines.withColumn("date", S.find_date(F.col("line"))).withColumn("complete", E.complete_line(F.col("line")))


def token_kinds(spark, sf_dir):
    tokens = line_split(spark, sf_dir).select("stem", "engine", "line_pos", F.posexplode(S.tokens_of(F.col("line"))).alias("tok_pos", "tok"))
    t = F.col("tok")
    return tokens.withColumns(
        {
            "is_date": S.is_whole(t, S.DATE),
            "is_money": S.is_whole(t, S.MONEY),
            "is_int": S.is_whole(t, S.INT),
            "money": F.when(S.is_whole(t, S.MONEY), S.norm_money(t)).otherwise(""),
            "norm_date": F.when(S.is_whole(t, S.DATE), S.norm_date(t)).otherwise(""),
        }
    )


def detect_shape(spark, sf_dir):
    return render_ledgers(spark, sf_dir).select("stem", "engine", E.shape(F.col("text")).alias("shape"))


def extract_fields(spark, sf_dir):
    return E.extract_fields(render_ledgers(spark, sf_dir))


def align_rows(spark, sf_dir):
    return fusion.align_readings(extract_fields(spark, sf_dir)).select("stem", "row_pos", "date", F.col("other.row_pos").alias("other_pos"), F.col("other.date").alias("other_date"))


def fuse_rows(spark, sf_dir):
    return fusion.fuse_readings(extract_fields(spark, sf_dir))


def fuse_provenance(spark, sf_dir):
    sources = fuse_rows(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_source").alias("source")) for f in ("date", "qty", "price", "total")])).alias("x"))
    return sources.groupBy("x.field", "x.source").agg(F.count("*").alias("n"))


def _texts(spark, sf_dir):
    return scoring.rows_to_text(fusion.with_fused(extract_fields(spark, sf_dir)), ("stem", "engine"))


def rows_to_text(spark, sf_dir):
    return _texts(spark, sf_dir)


def fusion_scores(spark, sf_dir):
    truth = scoring.rows_to_text(truth_rows(spark, sf_dir))
    return scoring.score(_texts(spark, sf_dir), truth, truth.select("stem"), ENGINES)


def engine_summary(spark, sf_dir):
    means = scoring.summary(fusion_scores(spark, sf_dir))
    return means.select("engine", F.round("mean_cer", 9).alias("mean_cer"), F.round("mean_wer", 9).alias("mean_wer"), "n_images")


def best_engine(spark, sf_dir):
    return scoring.best(scoring.summary(fusion_scores(spark, sf_dir)))


def truth_left_join(spark, sf_dir):
    """Whole texts against their truth, which every fourth stem lacks: those score null."""
    truth = scoring.rows_to_text(truth_rows(spark, sf_dir)).where("stem % 4 <> 0")
    texts = render_ledgers(spark, sf_dir)
    return scoring.score(texts, truth, texts.select("stem").distinct(), ENGINES[:2])


def partial_summary(spark, sf_dir):
    """Means of scores that are null for every fourth stem."""
    means = scoring.summary(truth_left_join(spark, sf_dir))
    return means.select("engine", F.round("mean_cer", 9).alias("mean_cer"), F.round("mean_wer", 9).alias("mean_wer"), "n_images")


def records_save(spark, sf_dir):
    rows = fuse_rows(spark, sf_dir).withColumn("source_file", F.concat(F.col("stem").cast("string"), F.lit(".png")))
    return records.number(records.filled(rows), ["stem", "row_pos"], "2026-01-01T00:00:00+00:00").select("id", *S.FIELDS, "source_file", "created_at")


def export_name(spark, sf_dir):
    return records.export_name(records_save(spark, sf_dir))


def records_export(spark, sf_dir):
    """All records as the objects of one JSON array."""
    return records.export_json(checkpoint(records_save(spark, sf_dir)))


def _forms(spark, sf_dir):
    """A form for each ledger, with a cell for each field of its rows; some forms count wrong, some rows are blank."""
    rows = truth_rows(spark, sf_dir)
    blank = (F.col("stem") + F.col("row_pos")) % 3 == 0
    cells = F.flatten(F.collect_list(F.array(*[F.struct(F.concat(F.lit(f"{f}_"), F.col("row_pos").cast("string")).alias("k"), F.when(blank, " ").otherwise(F.concat(F.lit(" "), f)).alias("v")) for f in S.FIELDS])))
    n = F.when(F.col("stem") % 7 == 0, "many").when(F.col("stem") % 5 == 0, F.lit(" 2 ")).otherwise(F.count("*").cast("string"))
    return rows.groupBy("stem").agg(F.concat(F.col("stem").cast("string"), F.lit(".png ")).alias("source_file"), n.alias("num_rows"), F.map_from_entries(cells).alias("cells"))


def form_corrections(spark, sf_dir):
    return records.corrections(_forms(spark, sf_dir))


def corrections_save(spark, sf_dir):
    """Rows of forms as numbered records, those without any field passed over."""
    rows = records.filled(form_corrections(spark, sf_dir)).withColumn("stem", F.regexp_extract("source_file", "[0-9]+", 0).cast("bigint"))
    return records.number(rows, ["stem", "i"], "2026-01-01T00:00:00+00:00").select("id", *S.FIELDS, "source_file")


def unique_stem(spark, sf_dir):
    """Names of uploads, good and bad, at the times of orders."""
    k = F.col("o_orderkey")
    name = F.get(F.array(*map(F.lit, ("my scan.png", "../../etc/passwd", "..", "", "a/b c.tar.gz", "_x_.JPG", "???.png", "été 2026.png", "Straße ﬁn\u00a0al.jpg", "Ñandú½.tiff", "日本.png"))), (k % 11).cast("int"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", S.unique_stem(name, F.timestamp_seconds(F.lit(1_700_000_000) + k)).alias("stem"), S.processed_name(name).alias("processed"))


def choose_date(spark, sf_dir):
    """Dates of the two readings of a row, with the winner."""
    rows = truth_rows(spark, sf_dir)
    a = F.when(F.col("stem") % 5 == 0, F.translate("date", "-", "/")).otherwise(F.col("date"))
    b = F.when(F.col("stem") % 3 == 0, "").when(F.col("stem") % 4 == 0, F.substring("date", 1, 8)).otherwise(F.col("date"))
    return rows.withColumn("c", fusion.choose_date(a, b)).select("stem", "row_pos", "c.value", "c.winner")


def image_names(spark, sf_dir):
    """Names of scans, made from ledgers' numbers: which are images, and the stems of cleaned ones."""
    suffix = F.get(F.array(*map(F.lit, ("png", "JPG", "txt", "webp", "tiff", "csv"))), (F.col("o_orderkey") % 6).cast("int"))
    name = F.concat(F.lit("scan_"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_clean").otherwise(""), F.lit("."), suffix)
    names = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", name.alias("name"))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    return names.select("o_orderkey", "name", S.is_image(F.col("name")).alias("is_image"), S.original_stem(stem).alias("stem"))


def documents_dates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "_")
    return docs.select("doc_id", S.find_date(plain).alias("date"))


QUERIES = {
    f.__name__: f
    for f in (
        render_ledgers, line_split, token_kinds, detect_shape, extract_fields, align_rows, fuse_rows, fuse_provenance, rows_to_text,
        fusion_scores, engine_summary, best_engine, truth_left_join, partial_summary, records_save, export_name, records_export,
        form_corrections, corrections_save, unique_stem, choose_date, image_names, documents_dates,
    )
}

# fixed values
_DATE = r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
_MONEY = r"[£$€]?\d+[.,]\d{1,2}"
_CTES = rf"""
WITH truth AS (
  SELECT l_orderkey AS stem, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS INT) AS row_pos,
         strftime(l_shipdate, '%Y-%m-%d') AS date, p_name AS item, CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) AS qty,
         printf('%.2f', p_retailprice) AS price, printf('%.2f', l_extendedprice) AS total, l_partkey AS p, l_suppkey AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sides AS (
  SELECT stem, row_pos,
         concat_ws(' ', CASE WHEN p % 5 = 0 THEN replace(date, '-', '/') ELSE date END, item, CASE WHEN p % 11 = 0 THEN replace(qty, '5', 'S') ELSE qty END,
                   CASE WHEN p % 7 = 0 THEN replace(price, '.', '') ELSE price END, total) AS a,
         CASE WHEN s % 13 <> 0 THEN concat_ws(chr(10), CASE WHEN s % 17 = 0 THEN substr(date, 1, 9) || '9' ELSE date END, item, qty,
                   CASE WHEN s % 6 = 0 THEN replace(price, '.', ',') ELSE price END, total) END AS b
  FROM truth),
readings AS (
  SELECT stem, 'tesseract' AS engine, 'Shop ledger' || chr(10) || 'Date Item Qty Price Total' || chr(10) || string_agg(a, chr(10) ORDER BY row_pos) || CASE WHEN stem % 3 = 0 THEN chr(10) || 'Thank you' ELSE '' END AS text
  FROM sides GROUP BY stem
  UNION ALL
  SELECT stem, 'easyocr', 'Ledger' || chr(10) || coalesce(string_agg(b, chr(10) ORDER BY row_pos), '') FROM sides GROUP BY stem),
cut AS (SELECT stem, engine, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM readings),
lines AS (
  SELECT stem, engine, CAST(pos - 1 AS INT) AS line_pos, line, regexp_extract(line, '\b{_DATE}\b') AS date, list_filter(string_split_regex(line, '\s+'), lambda t: t <> '') AS ws
  FROM (SELECT stem, engine, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut)),
full_lines AS (SELECT *, date <> '' AND len(list_filter(ws, lambda t: regexp_full_match(t, '{_MONEY}'))) > 0 AND len(ws) >= 3 AS complete FROM lines),
shapes AS (SELECT stem, engine, CASE WHEN sum(complete::INT) >= 2 THEN 'flat' ELSE 'tokens' END AS shape FROM full_lines GROUP BY ALL),
toks AS (
  SELECT *, regexp_full_match(tok, '{_DATE}') AS is_date, regexp_full_match(tok, '{_MONEY}') AS is_money, regexp_full_match(tok, '\d+') AS is_int
  FROM (SELECT stem, engine, line_pos, date AS line_date, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS tok_pos, unnest(ws) AS tok FROM full_lines)),
keyed AS (
  SELECT t.*, CASE WHEN shape = 'flat' THEN CASE WHEN line_date <> '' THEN line_pos + 1 ELSE 0 END
              ELSE sum(is_date::INT) OVER (PARTITION BY t.stem, t.engine ORDER BY line_pos, tok_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS seg
  FROM toks t JOIN shapes s ON t.stem = s.stem AND t.engine = s.engine),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stem, engine, seg, is_int ORDER BY line_pos, tok_pos) AS nth_int FROM keyed WHERE seg > 0),
parsed AS (
  SELECT stem, engine, seg, regexp_extract(string_agg(tok, ' ' ORDER BY line_pos, tok_pos), '\b{_DATE}\b') AS date,
         coalesce(string_agg(tok, ' ' ORDER BY line_pos, tok_pos) FILTER (WHERE NOT is_date AND NOT is_money AND NOT (is_int AND nth_int = 1)), '') AS item,
         coalesce(max(tok) FILTER (WHERE is_int AND nth_int = 1), '') AS qty,
         list(replace(regexp_extract(tok, '\d+[.,]\d{{1,2}}'), ',', '.') ORDER BY line_pos, tok_pos) FILTER (WHERE is_money AND NOT is_date) AS m
  FROM ranked GROUP BY ALL),
extracted AS MATERIALIZED (
  SELECT stem, engine, CAST(row_number() OVER (PARTITION BY stem, engine ORDER BY seg) - 1 AS INT) AS row_pos, date, item, qty,
         CASE WHEN len(m) >= 2 THEN m[len(m) - 1] ELSE '' END AS price, CASE WHEN len(m) >= 1 THEN m[len(m)] ELSE '' END AS total
  FROM parsed WHERE date <> ''),
dated AS MATERIALIZED (SELECT *, regexp_replace(date, '[./]', '-', 'g') AS nd, row_number() OVER (PARTITION BY stem, engine, regexp_replace(date, '[./]', '-', 'g') ORDER BY row_pos) AS k FROM extracted),
ta AS MATERIALIZED (SELECT * FROM dated WHERE engine = 'tesseract'), tb AS MATERIALIZED (SELECT * FROM dated WHERE engine = 'easyocr'),
la AS MATERIALIZED (SELECT stem, row_pos, row_number() OVER (PARTITION BY stem ORDER BY row_pos) AS j FROM ta WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.stem = ta.stem AND tb.nd = ta.nd AND tb.k = ta.k)),
lb AS MATERIALIZED (SELECT stem, row_pos, row_number() OVER (PARTITION BY stem ORDER BY row_pos) AS j FROM tb WHERE NOT EXISTS (SELECT 1 FROM ta WHERE tb.stem = ta.stem AND tb.nd = ta.nd AND tb.k = ta.k)),
pairs AS MATERIALIZED (
  SELECT ta.stem, ta.row_pos, coalesce(tb.row_pos, lb.row_pos) AS other_pos
  FROM ta LEFT JOIN tb ON tb.stem = ta.stem AND tb.nd = ta.nd AND tb.k = ta.k
  LEFT JOIN la ON la.stem = ta.stem AND la.row_pos = ta.row_pos LEFT JOIN lb ON lb.stem = la.stem AND lb.j = la.j),
met AS MATERIALIZED (
  SELECT ta.stem, ta.row_pos, ta.date, ta.item, ta.qty, ta.price, ta.total, p.other_pos, tb.date AS other_date,
         coalesce(tb.date, '') AS od, coalesce(tb.qty, '') AS oq, coalesce(tb.price, '') AS op, coalesce(tb.total, '') AS ot
  FROM ta JOIN pairs p ON p.stem = ta.stem AND p.row_pos = ta.row_pos LEFT JOIN tb ON tb.stem = p.stem AND tb.row_pos = p.other_pos),
won AS (
  SELECT *, CASE WHEN date = od THEN 'agree' WHEN regexp_full_match(od, '{_DATE}') THEN 'easyocr' ELSE 'tesseract' END AS date_source,
         CASE WHEN qty = oq THEN 'agree' WHEN regexp_full_match(oq, '\d+') THEN 'easyocr' WHEN regexp_full_match(qty, '\d+') THEN 'tesseract' WHEN oq <> '' THEN 'easyocr' ELSE 'tesseract' END AS qty_source,
         CASE WHEN price = op THEN 'agree' WHEN regexp_full_match(op, '\d+\.\d{{1,2}}') THEN 'easyocr' WHEN regexp_full_match(price, '\d+\.\d{{1,2}}') THEN 'tesseract' WHEN op <> '' THEN 'easyocr' ELSE 'tesseract' END AS price_source,
         CASE WHEN total = ot THEN 'agree' WHEN regexp_full_match(ot, '\d+\.\d{{1,2}}') THEN 'easyocr' WHEN regexp_full_match(total, '\d+\.\d{{1,2}}') THEN 'tesseract' WHEN ot <> '' THEN 'easyocr' ELSE 'tesseract' END AS total_source
  FROM met),
chosen AS (
  SELECT stem, row_pos, CASE date_source WHEN 'easyocr' THEN od ELSE date END AS date, item, CASE qty_source WHEN 'easyocr' THEN oq ELSE qty END AS qty,
         CASE price_source WHEN 'easyocr' THEN op ELSE price END AS price, CASE total_source WHEN 'easyocr' THEN ot ELSE total END AS total,
         date_source, qty_source, price_source, total_source FROM won),
fused AS MATERIALIZED (
  SELECT stem, row_pos, date, CASE WHEN price <> '' AND total <> '' THEN regexp_replace(item, '((^|\s+)(\d+|{_MONEY}))+$', '') ELSE item END AS item,
         qty, price, total, date_source, qty_source, price_source, total_source FROM chosen),
texts AS (
  SELECT stem, engine, string_agg(concat_ws(' ', date, item, qty, price, total), chr(10) ORDER BY row_pos) AS text
  FROM (SELECT stem, engine, row_pos, date, item, qty, price, total FROM extracted UNION ALL SELECT stem, 'fused', row_pos, date, item, qty, price, total FROM fused) GROUP BY ALL),
truth_texts AS (SELECT stem, string_agg(concat_ws(' ', date, item, qty, price, total), chr(10) ORDER BY row_pos) AS truth FROM truth GROUP BY stem),
coded AS (
  SELECT t.stem, e.engine, trim(coalesce(x.text, '')) AS p, trim(truth) AS t,
         list_filter(string_split(trim(regexp_replace(coalesce(x.text, ''), '\s\s+', ' ', 'g')), ' '), lambda w: w <> '') AS pw,
         list_filter(string_split(trim(regexp_replace(truth, '\s\s+', ' ', 'g')), ' '), lambda w: w <> '') AS tw
  FROM truth_texts t CROSS JOIN (SELECT unnest(['tesseract', 'easyocr', 'fused']) AS engine) e LEFT JOIN texts x ON x.stem = t.stem AND x.engine = e.engine),
numbered AS (SELECT *, list_distinct(list_concat(pw, tw)) AS v FROM coded),
whole AS (
  SELECT r.stem, r.engine, CASE WHEN r.stem % 4 <> 0 THEN trim(truth) END AS t, rtrim(text, chr(10)) AS p,
         list_filter(string_split(regexp_replace(text, '\s\s+', ' ', 'g'), ' '), lambda w: w <> '') AS pw,
         list_filter(string_split(trim(truth), ' '), lambda w: w <> '') AS tw
  FROM readings r JOIN truth_texts t ON r.stem = t.stem),
whole_scores AS (
  SELECT stem, engine, CASE WHEN t IS NOT NULL THEN least(1.0::DOUBLE, levenshtein(t, p)::DOUBLE / length(t)) END AS cer,
         CASE WHEN t IS NOT NULL THEN least(1.0::DOUBLE, levenshtein(array_to_string(list_transform(tw, lambda w: chr((32 + list_position(v, w))::INT)), ''), array_to_string(list_transform(pw, lambda w: chr((32 + list_position(v, w))::INT)), ''))::DOUBLE / len(tw)) END AS wer
  FROM (SELECT *, list_distinct(list_concat(pw, tw)) AS v FROM whole)),
forms AS (
  SELECT stem, stem || '.png' AS source_file, row_pos AS i, CASE WHEN (stem + row_pos) % 3 = 0 THEN '' ELSE date END AS date, CASE WHEN (stem + row_pos) % 3 = 0 THEN '' ELSE item END AS item,
         CASE WHEN (stem + row_pos) % 3 = 0 THEN '' ELSE qty END AS qty, CASE WHEN (stem + row_pos) % 3 = 0 THEN '' ELSE price END AS price, CASE WHEN (stem + row_pos) % 3 = 0 THEN '' ELSE total END AS total
  FROM truth WHERE stem % 7 <> 0 AND (stem % 5 <> 0 OR row_pos < 2)
  UNION ALL SELECT stem, stem || '.png', 1, '', '', '', '', '' FROM truth WHERE stem % 7 <> 0 AND stem % 5 = 0 GROUP BY stem HAVING count(*) = 1),
scores AS (
  SELECT stem, engine, CASE WHEN t = '' AND p = '' THEN 0.0 WHEN t = '' THEN 1.0 ELSE least(1.0::DOUBLE, levenshtein(t, p)::DOUBLE / length(t)) END AS cer,
         CASE WHEN len(tw) = 0 AND len(pw) = 0 THEN 0.0 WHEN len(tw) = 0 THEN 1.0
              ELSE least(1.0::DOUBLE, levenshtein(array_to_string(list_transform(tw, lambda w: chr((32 + list_position(v, w))::INT)), ''), array_to_string(list_transform(pw, lambda w: chr((32 + list_position(v, w))::INT)), ''))::DOUBLE / len(tw)) END AS wer
  FROM numbered),
records AS (
  SELECT row_number() OVER (ORDER BY stem, row_pos) AS id, date, item, qty, price, total, CAST(stem AS VARCHAR) || '.png' AS source_file, '2026-01-01T00:00:00+00:00' AS created_at
  FROM fused WHERE concat(date, item, qty, price, total) <> '')
"""

_BODY = {
    "render_ledgers": "SELECT * FROM readings",
    "line_split": "SELECT stem, engine, line_pos, line, date, complete FROM full_lines",
    "token_kinds": """SELECT stem, engine, line_pos, tok_pos, tok, is_date, is_money, is_int,
        CASE WHEN is_money THEN replace(regexp_extract(tok, '\\d+[.,]\\d{1,2}'), ',', '.') ELSE '' END AS money,
        CASE WHEN is_date THEN regexp_replace(tok, '[./]', '-', 'g') ELSE '' END AS norm_date FROM toks""",
    "detect_shape": "SELECT * FROM shapes",
    "extract_fields": "SELECT * FROM extracted",
    "align_rows": "SELECT stem, row_pos, date, other_pos, other_date FROM met",
    "fuse_rows": "SELECT * FROM fused",
    "fuse_provenance": """SELECT field, source, count(*) AS n FROM (SELECT 'date' AS field, date_source AS source FROM fused UNION ALL SELECT 'qty', qty_source FROM fused
        UNION ALL SELECT 'price', price_source FROM fused UNION ALL SELECT 'total', total_source FROM fused) GROUP BY ALL""",
    "rows_to_text": "SELECT * FROM texts",
    "fusion_scores": "SELECT * FROM scores",
    "engine_summary": "SELECT engine, round(avg(cer), 9) AS mean_cer, round(avg(wer), 9) AS mean_wer, count(*) AS n_images FROM scores GROUP BY engine",
    "best_engine": "SELECT engine AS best_engine FROM scores GROUP BY engine ORDER BY avg(cer), CASE engine WHEN 'tesseract' THEN 0 WHEN 'easyocr' THEN 1 ELSE 2 END LIMIT 1",
    "truth_left_join": "SELECT * FROM whole_scores",
    "partial_summary": "SELECT engine, round(avg(cer), 9) AS mean_cer, round(avg(wer), 9) AS mean_wer, count(*) AS n_images FROM whole_scores WHERE cer IS NOT NULL GROUP BY engine",
    "form_corrections": "SELECT source_file, i, date, item, qty, price, total FROM forms",
    "corrections_save": "SELECT row_number() OVER (ORDER BY stem, i) AS id, date, item, qty, price, total, source_file FROM forms WHERE concat(date, item, qty, price, total) <> ''",
    "records_export": """SELECT id, CASE WHEN id = min(id) OVER () THEN '[' || chr(10) ELSE '' END || '  {' || chr(10) || '    "id": ' || id || ',' || chr(10) || '    "date": ' || CAST(to_json(date) AS VARCHAR) || ',' || chr(10)
        || '    "item": ' || CAST(to_json(item) AS VARCHAR) || ',' || chr(10) || '    "qty": ' || CAST(to_json(qty) AS VARCHAR) || ',' || chr(10) || '    "price": ' || CAST(to_json(price) AS VARCHAR) || ',' || chr(10)
        || '    "total": ' || CAST(to_json(total) AS VARCHAR) || ',' || chr(10) || '    "source_file": ' || CAST(to_json(source_file) AS VARCHAR) || ',' || chr(10) || '    "created_at": ' || CAST(to_json(created_at) AS VARCHAR) || chr(10)
        || '  }' || CASE WHEN id = max(id) OVER () THEN chr(10) || ']' ELSE ',' END AS json FROM records""",
    "choose_date": f"""SELECT stem, row_pos, CASE winner WHEN 'easyocr' THEN b ELSE a END AS value, winner FROM (
        SELECT stem, row_pos, a, b, CASE WHEN a = b THEN 'agree' WHEN regexp_full_match(b, '{_DATE}') THEN 'easyocr' ELSE 'tesseract' END AS winner
        FROM (SELECT stem, row_pos, CASE WHEN stem % 5 = 0 THEN replace(date, '-', '/') ELSE date END AS a, CASE WHEN stem % 3 = 0 THEN '' WHEN stem % 4 = 0 THEN left(date, 8) ELSE date END AS b FROM truth))""",
    "records_save": "SELECT * FROM records",
    "export_name": """SELECT CASE count(DISTINCT source_file) WHEN 0 THEN 'records' WHEN 1 THEN min(regexp_replace(source_file, '\\.[^.]+$', '')) ELSE 'records_multiple_sources' END AS name,
        count(*) AS n_records,
        'Exported ' || count(*) || ' record(s) as ' || CASE count(DISTINCT source_file) WHEN 0 THEN 'records' WHEN 1 THEN min(regexp_replace(source_file, '\\.[^.]+$', '')) ELSE 'records_multiple_sources' END
        || '.csv' || CASE count(DISTINCT source_file) WHEN 1 THEN ' (source: ' || min(source_file) || ')' ELSE '' END || '.' AS message FROM records""",
}
ORACLES = {name: _CTES + body for name, body in _BODY.items()}
ORACLES["image_names"] = r"""
SELECT o_orderkey, name, regexp_matches(lower(name), '\.(png|jpg|jpeg|tif|tiff|bmp|webp)$') AS is_image, regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '_clean$', '') AS stem
FROM (SELECT o_orderkey, 'scan_' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '_clean' ELSE '' END || '.' || ['png', 'JPG', 'txt', 'webp', 'tiff', 'csv'][o_orderkey % 6 + 1] AS name FROM orders)"""
ORACLES["documents_dates"] = rf"""SELECT doc_id, regexp_extract(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g'), '\b{_DATE}\b') AS date FROM documents"""
ORACLES["unique_stem"] = r"""
SELECT o_orderkey, strftime(make_timestamp((1700000000 + o_orderkey) * 1000000), '%Y%m%dT%H%M%S%f') || '_' || ['my_scan', 'etc_passwd', 'upload', 'upload', 'a_b_c.tar', 'x_', 'png', 'ete_2026', 'Strae_fin_al', 'Nandu12', 'png'][o_orderkey % 11 + 1] AS stem,
       ['my scan', '../../etc/passwd', '.', '', 'a/b c.tar', '_x_', '???', 'été 2026', 'Straße ﬁn' || chr(160) || 'al', 'Ñandú½', '日本'][o_orderkey % 11 + 1] || '_clean.png' AS processed FROM orders"""

"""Queries over documents and conversations: spans, redaction, confusion counts, clauses, perturbation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloflow.functions import spans as S
from siloflow.functions.regex import found
from siloflow.operators import extraction, metrics, perturb, pii

# Patterns without look-around, which the oracle's engine reads alike.
MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+[0-9]{1,3} ?\(?[0-9]{1,5}\)?[ .-]?[0-9]{2,6}[ .-][0-9]{2,6}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
NUMBERS = r"[0-9]+"
LETTER_HEX = r"[0-9a-f]{32,}"
CLAUSE = r"[;|\n]"
NEGATION = "(?:^| )(?:no|not|without|never|kein|keine|nicht|sin|sans|pas)(?: |$)"
MENTION = "(?:^| )(?:and|und|et|y) "

Spans = list[tuple[str, str]]
FLAGSHIP: Spans = [("EMAIL", MAIL), ("PHONE_NUMBER", PHONE)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _found(label: str, pattern: str, text: str = "text") -> Column:
    return F.transform(found(F.col(text), pattern), lambda m: S.span(m["start"], m["end"], label, "pattern"))


def _with_spans(docs: DataFrame, kinds: Spans, into: str = "spans") -> DataFrame:
    """Spans of several kinds, the earlier kind winning where two overlap; texts without a digit or @ are passed over."""
    some = F.col("text").rlike("[0-9@]")
    spans = S.resolve([(i, _found(label, p)) for i, (label, p) in enumerate(kinds)])
    return docs.withColumn(into, F.when(some, spans).otherwise(S.none()))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    got = _with_spans(docs, FLAGSHIP)
    return got.select("doc_id", "lang", F.size("spans").cast("long").alias("n_spans"), S.render(F.col("text"), F.col("spans")).alias("redacted"))


def _rows(docs: DataFrame, kinds: Spans) -> DataFrame:
    got = _with_spans(docs.select("doc_id", "lang", "text"), kinds)
    return got.select("doc_id", "lang", "text", F.explode("spans").alias("s")).select("doc_id", "lang", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.label").alias("label"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("said"))


def pii_email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(table(spark, sf_dir, "documents"), FLAGSHIP[:1]).select("doc_id", "start", "end", "said")


def pii_phone_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(table(spark, sf_dir, "documents"), FLAGSHIP[1:]).select("doc_id", "start", "end", "said")


def pii_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rows(table(spark, sf_dir, "documents"), FLAGSHIP)
    return got.cube("lang", "label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("n_chars"))


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers count only where no address or phone number covers them."""
    return _rows(table(spark, sf_dir, "documents"), [*FLAGSHIP, ("NUMBER", NUMBERS)]).select("doc_id", "start", "end", "label")


def _both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: addresses and phone numbers. Prediction: addresses cut short by a character, and IPv4 numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where(F.col("text").rlike("[0-9@]"))
    got = _with_spans(docs, FLAGSHIP, "t_spans")
    cut = F.transform(F.filter("t_spans", lambda s: s["label"] == "EMAIL"), lambda s: S.span(s["start"], s["end"] - 1, s["label"], "short"))
    whole = F.filter("t_spans", lambda s: s["label"] == "PHONE_NUMBER")
    odd = F.pmod(F.col("doc_id"), F.lit(2)) == 1
    ips = F.transform(_found("IPV4", IPV4), lambda s: S.span(s["start"], s["end"], "PHONE_NUMBER", "ip"))
    return got.withColumn("p_spans", F.concat(cut, F.when(odd, whole).otherwise(S.none()), S.free_of(ips, F.col("t_spans"))))


def char_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _both_sides(spark, sf_dir)
    tp = S.overlap_length(F.col("t_spans"), F.col("p_spans"))
    sums = got.groupBy("lang").agg(
        F.sum(tp).cast("long").alias("tp"), F.sum(S.total_length(F.col("p_spans")) - tp).cast("long").alias("fp"), F.sum(S.total_length(F.col("t_spans")) - tp).cast("long").alias("fn")
    )
    return sums.withColumn("f1", F.round(metrics.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))


def entity_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _both_sides(spark, sf_dir)
    side = lambda c: got.select("doc_id", F.inline(S.to_json(F.col(c))))
    out = metrics.entity_confusion(side("t_spans"), side("p_spans"), "doc_id")
    return out.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = F.filter(F.split("text", CLAUSE, -1), lambda c: F.trim(c) != "")
    return docs.select("doc_id", parts.alias("c")).select("doc_id", F.size("c").cast("long").alias("n_clauses"), F.coalesce(F.array_max(F.transform("c", F.length)), F.lit(0)).cast("long").alias("longest"))


def negation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that say 'and' (in four languages), and how many of them have a negation before it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(F.split(F.lower("text"), CLAUSE, -1)).alias("c"))
    said = docs.withColumn("before", F.regexp_extract("c", f"^(.*?){MENTION}", 1)).where(F.col("c").rlike(MENTION))
    return said.groupBy("lang").agg(F.count("*").alias("n_mentions"), F.count_if(F.col("before").rlike(NEGATION)).alias("n_negated"))


def starter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and first-number fields of a plain baseline, over notes made from conversations."""
    talk = table(spark, sf_dir, "conversations")
    note = F.concat(F.col("role"), F.lit(": HR "), (60 + F.col("turn") * 7).cast("string"), F.lit(" bpm, BP "), (110 + F.col("turn")).cast("string"), F.lit("/70. "), F.lit("Known heart failure. "), F.col("text"))
    got = talk.select("conv_id", "turn", note.alias("note")).withColumn("low", F.lower("note"))
    number = lambda p: F.regexp_extract("note", p, 1)
    filled = lambda c: F.when(c != "", c).cast("int")
    return got.select(
        "conv_id", "turn",
        F.contains(F.col("low"), F.lit("heart failure")).alias("heart_failure"),
        F.contains(F.col("low"), F.lit("hypertension")).alias("hypertension"),
        filled(number(r"(?i)(?:\bhr\b|pulse|ventricular rate)\s*[=:]?\s*([0-9]{2,3})")).alias("heart_rate_bpm"),
        filled(number(r"(?i)(?:\bbp\b|blood pressure)\s*[=:]?\s*([0-9]{2,3})(?:\s*/|\s+over\s+)")).alias("systolic_bp_mmhg"),
    )


def perturb_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends become bars; spans of mail addresses move along."""
    docs = _with_spans(table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where("text like '%@%'"), FLAGSHIP[:1])
    got = perturb.perturb(docs, "text", "spans", "layout_single_line")
    return got.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.explode("spans").alias("s"), "text").select("doc_id", "n_chars", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("said"))


def perturb_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written d.m.yyyy, read back and written in four other styles."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "d.M.yyyy").alias("said"))
    p = perturb.parsed_date(F.col("said"))
    return orders.select("o_orderkey", "said", *(style(p).alias(name) for name, style in perturb.DATE_STYLES.items()))


def date_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-month readings of made-up dates, half of them out of range."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((F.pmod("o_orderkey", F.lit(40))).cast("string"), F.lit("."), F.pmod("o_orderkey", F.lit(15)).cast("string"), F.lit(".2024")).alias("said"))
    return orders.select("o_orderkey", "said", pii.valid_date(F.col("said")).alias("valid"))


def detected_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full detector over all documents: spans by language and label."""
    got = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text")
    return got.select("lang", F.explode_outer("pii_entities").alias("s")).where("s is not null").groupBy("lang", F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def extracted_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine clinical fields of every document."""
    got = extraction.extract(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return got.select("doc_id", "extracted_clinical_data.*")


QUERIES = {
    f.__name__: f
    for f in (
        redact_documents, pii_email_spans, pii_phone_spans, pii_counts_by_lang, overlap_resolution, char_confusion, entity_confusion, clause_split,
        negation_scope, starter_fields, perturb_layout, perturb_dates, date_validity, detected_notes, extracted_notes,
    )
}


def _sql_spans(label: str, pattern: str, source: str = "documents") -> str:
    """All matches with code-point offsets: lengths of the gaps and matches before each, added up."""
    return f"""
      SELECT doc_id, lang, '{label}' AS label, i, m[i] AS said,
             CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s
      FROM (SELECT doc_id, lang, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, lang, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {source}) t) u"""


_MAIL, _PHONE, _NUMBER, _IP = (_sql_spans(label, p) for label, p in (("EMAIL", MAIL), ("PHONE_NUMBER", PHONE), ("NUMBER", NUMBERS), ("IPV4", IPV4)))
_BASE = f"""
  mail AS ({_MAIL}), phone0 AS ({_PHONE}),
  phone AS (SELECT * FROM phone0 p WHERE NOT EXISTS (SELECT 1 FROM mail e WHERE e.doc_id = p.doc_id AND e.s < p.s + length(p.said) AND p.s < e.s + length(e.said))),
  base AS (SELECT * FROM mail UNION ALL SELECT * FROM phone)"""
_SIDES = f"""{_BASE},
  ip0 AS ({_IP}),
  truth AS (SELECT doc_id, lang, label, s, CAST(s + length(said) AS INTEGER) AS e FROM base),
  pred AS (
    SELECT doc_id, lang, label, s, e - 1 AS e FROM truth WHERE label = 'EMAIL'
    UNION ALL SELECT doc_id, lang, label, s, e FROM truth WHERE label = 'PHONE_NUMBER' AND doc_id % 2 = 1
    UNION ALL SELECT doc_id, lang, 'PHONE_NUMBER', s, CAST(s + length(said) AS INTEGER) FROM ip0 i
      WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.doc_id = i.doc_id AND t.s < i.s + length(i.said) AND i.s < t.e))"""
_F1 = "CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) END"

ORACLE = {
    "redact_documents": f"""
      WITH {_BASE}, cut AS (SELECT doc_id, count(*) AS n FROM base GROUP BY 1)
      SELECT d.doc_id, d.lang, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
             regexp_replace(regexp_replace(text, '{MAIL}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE_NUMBER]', 'g') AS redacted
      FROM documents d LEFT JOIN cut USING (doc_id)""",
    "pii_email_spans": f"""SELECT doc_id, s AS "start", CAST(s + length(said) AS INTEGER) AS "end", said FROM ({_MAIL}) t""",
    "pii_phone_spans": f"""SELECT doc_id, s AS "start", CAST(s + length(said) AS INTEGER) AS "end", said FROM ({_PHONE}) t""",
    "pii_counts_by_lang": f"""WITH {_BASE} SELECT lang, label, count(*) AS n, CAST(sum(length(said)) AS BIGINT) AS n_chars FROM base GROUP BY CUBE (lang, label)""",
    "overlap_resolution": f"""
      WITH {_BASE}, num AS ({_NUMBER}),
      free AS (SELECT * FROM num x WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.s + length(x.said) AND x.s < b.s + length(b.said)))
      SELECT doc_id, s AS "start", CAST(s + length(said) AS INTEGER) AS "end", label FROM (SELECT * FROM base UNION ALL SELECT * FROM free) t""",
    "char_confusion": f"""
      WITH {_SIDES},
      hit AS (SELECT t.lang, sum(greatest(0, least(t.e, p.e) - greatest(t.s, p.s))) AS tp FROM truth t JOIN pred p USING (doc_id) GROUP BY 1),
      tt AS (SELECT lang, sum(e - s) AS n FROM truth GROUP BY 1), pp AS (SELECT lang, sum(e - s) AS n FROM pred GROUP BY 1),
      langs AS (SELECT DISTINCT lang FROM documents WHERE regexp_matches(text, '[0-9@]')),
      c AS (SELECT lang, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(pp.n, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(tt.n, 0) - coalesce(tp, 0) AS BIGINT) AS fn
            FROM langs LEFT JOIN hit USING (lang) LEFT JOIN tt USING (lang) LEFT JOIN pp USING (lang))
      SELECT lang, tp, fp, fn, round(CAST({_F1.format(tp="tp", fp="fp", fn="fn")} AS DOUBLE), 6) AS f1 FROM c""",
    "entity_confusion": f"""
      WITH {_SIDES},
      b AS (SELECT coalesce(t.label, p.label) AS label, t.doc_id AS x, p.doc_id AS y
            FROM (SELECT DISTINCT doc_id, s, e, label FROM truth) t FULL JOIN (SELECT DISTINCT doc_id, s, e, label FROM pred) p USING (doc_id, s, e, label)),
      c AS (SELECT label, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS tp, count(*) FILTER (x IS NULL) AS fp, count(*) FILTER (y IS NULL) AS fn FROM b GROUP BY CUBE (label))
      SELECT label, tp, fp, fn, round(CAST(CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0 / (tp + fp) END AS DOUBLE), 6) AS "precision",
             round(CAST(CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1.0 / (tp + fn) END AS DOUBLE), 6) AS recall,
             round(CAST({_F1.format(tp="tp", fp="fp", fn="fn")} AS DOUBLE), 6) AS f1 FROM c""",
    "clause_split": r"""
      SELECT doc_id, CAST(len(c) AS BIGINT) AS n_clauses, CAST(coalesce(list_max(list_transform(c, lambda x: length(x))), 0) AS BIGINT) AS longest
      FROM (SELECT doc_id, list_filter(string_split_regex(text, '[;|\n]'), lambda x: trim(x) <> '') AS c FROM documents) t""",
    "negation_scope": rf"""
      SELECT lang, count(*) AS n_mentions, count(*) FILTER (regexp_matches(regexp_extract(c, '^(.*?){MENTION}', 1), '{NEGATION}')) AS n_negated
      FROM (SELECT lang, unnest(string_split_regex(lower(text), '[;|\n]')) AS c FROM documents) t
      WHERE regexp_matches(c, '{MENTION}') GROUP BY lang""",
    "starter_fields": r"""
      WITH n AS (SELECT conv_id, turn, role || ': HR ' || CAST(60 + turn * 7 AS VARCHAR) || ' bpm, BP ' || CAST(110 + turn AS VARCHAR) || '/70. ' || 'Known heart failure. ' || text AS note FROM conversations)
      SELECT conv_id, turn, contains(lower(note), 'heart failure') AS heart_failure, contains(lower(note), 'hypertension') AS hypertension,
             CAST(nullif(regexp_extract(note, '(?i)(?:\bhr\b|pulse|ventricular rate)\s*[=:]?\s*([0-9]{2,3})', 1), '') AS INTEGER) AS heart_rate_bpm,
             CAST(nullif(regexp_extract(note, '(?i)(?:\bbp\b|blood pressure)\s*[=:]?\s*([0-9]{2,3})(?:\s*/|\s+over\s+)', 1), '') AS INTEGER) AS systolic_bp_mmhg
      FROM n""",
    "perturb_layout": rf"""
      WITH d AS (SELECT doc_id, lang, text FROM documents WHERE text LIKE '%@%'), flat AS (SELECT doc_id, lang, replace(text, chr(10), ' | ') AS text FROM d),
      m AS ({_sql_spans("EMAIL", MAIL, "flat")})
      SELECT m.doc_id, CAST(length(flat.text) AS BIGINT) AS n_chars, s AS "start", CAST(s + length(said) AS INTEGER) AS "end", said FROM m JOIN flat USING (doc_id)""",
    "perturb_dates": """
      SELECT o_orderkey, strftime(o_orderdate, '%-d.%-m.%Y') AS said, strftime(o_orderdate, '%Y-%m-%d') AS dates_iso, strftime(o_orderdate, '%-d %B %Y') AS dates_long,
             strftime(o_orderdate, '%B %-d, %Y') AS dates_us_long, strftime(o_orderdate, '%d.%m.%y') AS dates_two_digit_year FROM orders""",
    "date_validity": """
      SELECT o_orderkey, CAST(o_orderkey % 40 AS VARCHAR) || '.' || CAST(o_orderkey % 15 AS VARCHAR) || '.2024' AS said,
             (o_orderkey % 15 BETWEEN 1 AND 12) AND (o_orderkey % 40 BETWEEN 1 AND 31) AS valid FROM orders""",
}

"""Queries that check contracts of labels, proposals and records, over rows derived from documents with every kind of fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import contracts as C
from inkwell.plans.catalogue import query
from inkwell.session import table

RULES = C.Rules(
    types=("lend", "borrow", "spend", "other"), statuses=("complete", "uncertain", "skipped"),
    required=("id", "annotation_status", "type", "target"), optional=("note",),
    null_target_types=("other",), null_label_statuses=("skipped",), note_statuses=("uncertain",))
COMBINED = C.Rules(**{**RULES.__dict__, "required": (*RULES.required, "value"), "optional": ("note", "span_status")})

_SPAN = {
    "text": "CASE {m} WHEN 3 THEN concat(' ', substr(text, {s} + 1, {n})) WHEN 7 THEN concat(substr(text, {s} + 1, {n}), '~') WHEN 8 THEN '' WHEN 10 THEN NULL ELSE trim(substr(text, {s} + 1, {n})) END",
    "start": "CASE {m} WHEN 4 THEN -1 WHEN 6 THEN {s} + {n} WHEN 9 THEN NULL WHEN 10 THEN NULL ELSE {s} END",
    "end": "CASE {m} WHEN 5 THEN 1000000 WHEN 10 THEN NULL ELSE {s} + {n} END",
}


def _span(name: str, m: str, s: str, n: str) -> dict[str, str]:
    return {f"{name}_{k}": f"CAST({v.format(m=f'({m})', s=f'({s})', n=f'({n})')} AS {'STRING' if k == 'text' else 'INT'})" for k, v in _SPAN.items()}


_KEYS = "CASE doc_id % 31 WHEN 1 THEN '{less}' WHEN 2 THEN '{all},extra' WHEN 3 THEN '{all},other,extra' ELSE '{all}' END"
#: Columns by expressions that Spark and DuckDB read alike.
_ROWS = {
    "doc_id": "doc_id", "text": "text", "id": "CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 43 = 0 THEN NULL ELSE concat('d', CAST(doc_id - doc_id % 53 % 2 AS STRING)) END",
    "annotation_status": "CASE doc_id % 9 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'skipped' WHEN 2 THEN 'done' WHEN 3 THEN NULL ELSE 'complete' END",
    "type": "CASE doc_id % 8 WHEN 0 THEN 'lend' WHEN 1 THEN 'borrow' WHEN 2 THEN 'other' WHEN 3 THEN 'gift' WHEN 4 THEN NULL ELSE 'spend' END",
    "note": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'why' END",
    "value_status": "CASE doc_id % 6 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'absent' WHEN 2 THEN NULL ELSE 'complete' END",
    "value_provenance": "CASE doc_id % 10 WHEN 0 THEN 'rule' WHEN 1 THEN 'guess' ELSE 'human' END",
    "confidence": "CASE doc_id % 12 WHEN 0 THEN NULL WHEN 1 THEN 1.5E0 WHEN 2 THEN -0.1E0 ELSE CAST(doc_id % 100 AS DOUBLE) / 100 END",
    **_span("target", "doc_id % 17", "doc_id % 20", "5 + doc_id % 9"), **_span("value", "doc_id % 19", "doc_id % 23 + 7", "3 + doc_id % 7"),
}
_LABEL = _KEYS.format(less="annotation_status,type", all="id,annotation_status,type,target,note")
_BOTH = "CASE WHEN doc_id % 4 = 0 THEN concat({0}, ',span_status') ELSE {0} END".format(_KEYS.format(less="id,type,target", all="id,annotation_status,type,target,value"))
_MERGED = _KEYS.format(less="id,text,type", all="id,text,type,target,value,value_status,value_provenance")


def rows(spark: SparkSession, sf_dir: str, keys: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr(*[f"{v} AS `{k}`" for k, v in _ROWS.items()], f"split({keys}, ',') AS keys")


def rows_sql(keys: str) -> str:
    return "r AS (SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in _ROWS.items()) + f", string_split({keys}, ',') AS keys FROM documents)"


def _quoted(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(*cases: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in cases) + "], lambda x: x IS NOT NULL)"


_EDGE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def span_sql(p: str) -> str:
    x, s, e, there = f'"{p}_text"', f'"{p}_start"', f'"{p}_end"', f'("{p}_text" IS NOT NULL OR "{p}_start" IS NOT NULL OR "{p}_end" IS NOT NULL)'
    parts = _list(
        (f"COALESCE({x}, '') = ''", f"{p}.text: empty"), (f"{x} <> '' AND {x} <> trim({x}, {_EDGE})", f"{p}.text: edges"),
        (f"{x} <> '' AND {x} = trim({x}, {_EDGE}) AND {x} <> nfc_normalize({x})", f"{p}.text: not NFC"),
        (f"{s} IS NULL OR {s} < 0", f"{p}.start: not a position"), (f"{e} IS NULL OR {e} < 0", f"{p}.end: not a position"))
    whole = (f"CASE WHEN {s} >= {e} THEN ['{p}: start not before end'] WHEN {e} > length(text) THEN ['{p}: beyond the text'] "
             f"WHEN substr(text, {s} + 1, {e} - {s}) <> {x} THEN ['{p}: text differs'] ELSE []::VARCHAR[] END")
    return f"CASE WHEN NOT {there} THEN []::VARCHAR[] WHEN len({parts}) > 0 THEN {parts} ELSE {whole} END"


_THERE = '("{0}_text" IS NOT NULL OR "{0}_start" IS NOT NULL OR "{0}_end" IS NOT NULL)'
_BLANK = f"(note IS NULL OR trim(note, {_EDGE}) = '')"


def label_sql(r: C.Rules, *more: tuple[str, str]) -> str:
    t = _THERE.format("target")
    names = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return " || ".join((
        f"list_transform(list_filter({names(r.required)}, lambda k: NOT list_contains(keys, k)), lambda k: 'missing ' || k)",
        f"list_sort(list_transform(list_filter(keys, lambda k: NOT list_contains({names([*r.required, *r.optional])}, k)), lambda k: 'unknown ' || k))",
        _list(("list_contains(keys, 'id') AND COALESCE(id, '') = ''", "id: empty"),
              (f"list_contains(keys, 'annotation_status') AND COALESCE(annotation_status NOT IN {_quoted(r.statuses)}, true)", "annotation_status: not declared"),
              (f"annotation_status = 'uncertain' AND {_BLANK}", "note: required"), ("annotation_status = 'skipped' AND type IS NOT NULL", "type: must be null"),
              (f"annotation_status = 'skipped' AND {t}", "target: must be null"), ("type IS NULL AND annotation_status = 'complete'", "type: required"),
              (f"type NOT IN {_quoted(r.types)}", "type: not declared")),
        span_sql("target"), _list((f"{t} AND type = 'other'", "target: must be null for the type"), *more)))


_REQUIRED = (f"NOT {_THERE.format('target')} AND annotation_status = 'complete' AND type <> 'other'", "target: required")
_VALUE_LABEL_SQL = f"WITH {rows_sql(_LABEL)}, f AS (SELECT *, {label_sql(RULES, _REQUIRED)} AS broken FROM r)"


@query(f"WITH {rows_sql(_LABEL)} SELECT doc_id, {label_sql(RULES)} AS broken FROM r")
def enum_null_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, enumerations, null rules and span mechanics of labels."""
    return rows(spark, sf_dir, _LABEL).select("doc_id", C.label(RULES, F.col("text")).alias("broken"))


@query(f"{_VALUE_LABEL_SQL} SELECT doc_id, broken FROM f")
def value_label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose complete rows need a target."""
    return rows(spark, sf_dir, _LABEL).select("doc_id", C.label(RULES, F.col("text"), target_required=True).alias("broken"))


def label_file(labels: DataFrame, texts: DataFrame, broken) -> DataFrame:
    """(line, problem): each row's broken rules, ids that ``texts`` (id, text) lacks, and ids that an earlier line has."""
    told = labels.drop("text").join(texts, "id", "left").withColumn("broken", broken)
    told = told.withColumn("first", F.min("line").over(Window.partitionBy("id")))
    more = C.broken((F.col("id").isNotNull() & F.col("text").isNull(), "id: not in the queue"), (F.col("id").isNotNull() & (F.col("line") > F.col("first")), "id: duplicate"))
    return told.select("line", F.concat("broken", more).alias("broken")).select("line", F.explode("broken").alias("problem"))


@query(f"""WITH {rows_sql(_LABEL)}, q AS (SELECT concat('d', doc_id) AS id, text FROM documents WHERE doc_id % 7 <> 0), j AS (SELECT r.* EXCLUDE (text), q.text, r.doc_id AS line FROM r LEFT JOIN q USING (id)),
b AS (SELECT line, {label_sql(RULES, _REQUIRED)} || {_list(("id IS NOT NULL AND text IS NULL", "id: not in the queue"), ("id IS NOT NULL AND line > min(line) OVER (PARTITION BY id)", "id: duplicate"))} AS broken FROM j)
SELECT problem, count(*) AS n, min(line) AS first_line FROM (SELECT line, unnest(broken) AS problem FROM b) GROUP BY problem""")
def value_label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label file against its queue: how often each problem occurs and where first."""
    labels = rows(spark, sf_dir, _LABEL).withColumn("line", F.col("doc_id"))
    queue = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    found = label_file(labels, queue, C.label(RULES, F.col("text"), target_required=True))
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


_COMBINED_SQL = " || ".join((label_sql(COMBINED), span_sql("value"), _list(
    (f"{_THERE.format('value')} AND type = 'other'", "value: must be null for the type"), (f"annotation_status = 'skipped' AND {_THERE.format('value')}", "value: must be null"),
    ("list_contains(keys, 'span_status') AND annotation_status = 'skipped'", "span_status: must be absent"),
    ("list_contains(keys, 'span_status') AND annotation_status IS DISTINCT FROM 'skipped' AND COALESCE(value_status NOT IN ('complete', 'uncertain'), true)", "span_status.value: not declared"),
    (f"list_contains(keys, 'span_status') AND annotation_status IS DISTINCT FROM 'skipped' AND value_status = 'uncertain' AND {_BLANK}", "note: required by span_status"))))


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _BOTH).withColumn("broken", C.combined(COMBINED, F.col("text"), ("complete", "uncertain"), ("other",)))


@query(f"WITH {rows_sql(_BOTH)} SELECT doc_id, {_COMBINED_SQL} AS broken FROM r")
def combined_label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a target, a value and the value's status."""
    return _combined(spark, sf_dir).select("doc_id", "broken")


@query(f"""WITH {rows_sql(_BOTH)}, f AS (SELECT *, {_COMBINED_SQL} AS broken FROM r)
SELECT annotation_status AS status, count(*) AS n, count(*) FILTER (WHERE len(broken) = 0) AS valid, count(*) FILTER (WHERE id IS NOT NULL AND doc_id > first) AS duplicates
FROM (SELECT *, min(doc_id) OVER (PARTITION BY id) AS first FROM f) GROUP BY annotation_status""")
def combined_label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's report: rows, valid rows and repeated ids by status."""
    told = _combined(spark, sf_dir).withColumn("first", F.min("doc_id").over(Window.partitionBy("id")))
    return told.groupBy(F.col("annotation_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("broken") == 0).alias("valid"), F.count_if(F.col("id").isNotNull() & (F.col("doc_id") > F.col("first"))).alias("duplicates"))


@query(f"""WITH {rows_sql(_LABEL)} SELECT doc_id, {_list(("COALESCE(id, '') = ''", "id: empty"), ("annotation_status IS NULL", "annotation_status: missing"),
    (f"annotation_status NOT IN {_quoted(RULES.statuses)}", "annotation_status: not declared"), (f"type NOT IN {_quoted(RULES.types)}", "type: not declared"), ("type IS NULL AND annotation_status = 'complete'", "type: required"))}
  || {span_sql("target")} || {_list((f"{_THERE.format('target')} AND type = 'other'", "target: must be null for the type"), ("confidence < 0 OR confidence > 1", "confidence: not from 0 to 1"),
    (f"annotation_status = 'uncertain' AND {_BLANK}", "note: required"))} AS broken FROM r""")
def proposal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with a confidence."""
    return rows(spark, sf_dir, _LABEL).select("doc_id", C.proposal(RULES, F.col("text")).alias("broken"))


_MERGED_FIRST = " || ".join((
    _list(("text IS NULL OR text <> nfc_normalize(text)", "text: not NFC"), ("COALESCE(value_status NOT IN ('complete', 'uncertain'), true)", "value_status: not declared"),
          ("COALESCE(value_provenance NOT IN ('human', 'rule'), true)", "value_provenance: not declared")),
    span_sql("value"), _list((f"{_THERE.format('value')} AND value_status IS DISTINCT FROM 'complete'", "value: must be null"))))


@query(f"""WITH {rows_sql(_MERGED)}, m AS (SELECT *, list_transform(list_filter(['id', 'text', 'type', 'target', 'value', 'value_status', 'value_provenance'], lambda k: NOT list_contains(keys, k)), lambda k: 'missing ' || k) AS missing, {_MERGED_FIRST} AS first FROM r)
SELECT doc_id, CASE WHEN len(missing) > 0 THEN missing WHEN len(first) = 0 AND value_start < target_end AND target_start < value_end THEN ['value: overlaps the target'] ELSE first END AS broken FROM m""")
def merged_record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records with a target and a value that may not overlap."""
    return rows(spark, sf_dir, _MERGED).select("doc_id", C.merged(RULES, F.col("text")).alias("broken"))


@query(f"""WITH {rows_sql(_MERGED)}, l AS (SELECT *, list_filter(['value', 'value_status', 'value_provenance'], lambda k: NOT list_contains(keys, k)) AS lacks, {_THERE.format("value")} AS there FROM r)
SELECT doc_id, CASE WHEN len(lacks) > 0 THEN 'lacks ' || lacks[1] WHEN COALESCE(value_status NOT IN ('complete', 'uncertain'), true) THEN 'value_status' WHEN COALESCE(value_provenance NOT IN ('human', 'rule'), true) THEN 'value_provenance'
  WHEN there AND NOT COALESCE(value_start >= 0 AND value_start < value_end AND value_end <= length(text), false) THEN 'offsets' WHEN there AND NOT COALESCE(substr(text, value_start + 1, value_end - value_start) = value_text, false) THEN 'text differs'
  WHEN there AND value_text <> trim(value_text, {_EDGE}) THEN 'edges' END AS broken, COALESCE(value_status = 'complete', false) AS supervised FROM l""")
def value_record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bars a record from training a value model, and whether its value counts."""
    return rows(spark, sf_dir, _MERGED).select(
        "doc_id", C.value_record(RULES, F.col("text")).alias("broken"), F.col("value_status").eqNullSafe("complete").alias("supervised"))


@query(f"""WITH {rows_sql(_LABEL)} SELECT doc_id, CASE WHEN list_sort(keys) <> ['annotation_status', 'id', 'note', 'target', 'type'] THEN 'keys' WHEN COALESCE(type NOT IN {_quoted(RULES.types)}, true) THEN 'type'
  WHEN value_provenance IS DISTINCT FROM 'human' THEN 'annotator' WHEN {_THERE.format("target")} AND NOT COALESCE(substr(text, target_start + 1, target_end - target_start) = target_text, false) THEN 'target' END AS broken FROM r""")
def exact_record_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of exactly the declared fields, by one annotator."""
    told = rows(spark, sf_dir, _LABEL).withColumn("annotator", F.col("value_provenance"))
    return told.select("doc_id", C.exact_record(("id", "annotation_status", "type", "target", "note"), RULES.types, "human", F.col("text")).alias("broken"))


@query(f"""WITH {rows_sql(_LABEL)} SELECT doc_id, id, type FROM r WHERE annotation_status IN ('complete')""")
def trainable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a trainable status, with the fields that training reads."""
    return rows(spark, sf_dir, _LABEL).where(F.col("annotation_status").isin(*RULES.trainable)).select("doc_id", "id", "type")


@query(f"""WITH {rows_sql(_LABEL)}, t AS (SELECT concat('d', doc_id) AS id FROM documents WHERE doc_id % 29 = 0)
SELECT reason, count(*) AS n, list_sort(list(id)) AS ids FROM (SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'test id' WHEN starts_with(id, 'd9') THEN 'held-out prefix' WHEN value_provenance = 'guess' THEN 'batch' END AS reason FROM r WHERE id <> '') WHERE reason IS NOT NULL GROUP BY reason""")
def distillation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that may not be distilled from, by reason."""
    test = table(spark, sf_dir, "documents").where("doc_id % 29 = 0").select(F.concat(F.lit("d"), "doc_id").alias("id")).distinct().withColumn("held", F.lit(True))
    told = rows(spark, sf_dir, _LABEL).where("id <> ''").join(test, "id", "left")
    reason = F.when(F.col("held"), "test id").when(F.col("id").startswith("d9"), "held-out prefix").when(F.col("value_provenance") == "guess", "batch")
    return told.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


_SPAN_TEXTS = "('50k'), ('hai trăm nghìn'), ('500k/tháng'), ('khoảng 2tr'), ('tháng 5'), ('nhiều'), ('~30k'), ('kỳ 3 1tr5'), ('2tr / người'), ('')"
_F = "replace(strip_accents(lower(x)), 'đ', 'd')"


@query(rf"""SELECT x AS span, {_list((rf"NOT regexp_matches(x, '\d') AND NOT regexp_matches({_F}, '{C.NUMBER_WORDS}')", "no number"), (rf"regexp_matches({_F}, '{C.PER_UNIT}')", "per unit"),
    (rf"regexp_matches({_F}, '{C.APPROXIMATORS}')", "approximate"), (rf"regexp_matches({_F}, '{C.PERIODS}')", "period"))} AS warnings FROM (VALUES {_SPAN_TEXTS} UNION ALL SELECT substr(text, 1, 12) FROM documents) t(x)""".replace("FROM (VALUES", "FROM (SELECT * FROM (VALUES").replace("UNION ALL SELECT substr", ") v UNION ALL SELECT substr"))
def span_shape_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft findings on spans: literal amounts and the heads of all documents."""
    spans = spark.sql(f"SELECT * FROM VALUES {_SPAN_TEXTS} AS t(span)").union(table(spark, sf_dir, "documents").select(F.substring("text", 1, 12)))
    return spans.select("span", C.span_warnings(F.col("span")).alias("warnings"))


@query(f"""WITH {rows_sql(_LABEL)} SELECT doc_id, CASE WHEN annotation_status = 'complete' AND type IS DISTINCT FROM 'other' THEN COALESCE(target_text = value_text, false) WHEN annotation_status = 'complete' THEN value_text IS NULL ELSE true END AS matches,
  concat_ws(', ', type, annotation_status, target_text) AS intent FROM r""")
def value_matches_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a proposal's value is what its note intends, and the intent as a string."""
    status, kind = F.col("annotation_status"), F.col("type")
    whole = status.eqNullSafe("complete")
    same = F.coalesce(F.col("target_text") == F.col("value_text"), F.lit(False))
    return rows(spark, sf_dir, _LABEL).select(
        "doc_id", F.when(whole & ~kind.eqNullSafe("other"), same).when(whole, F.col("value_text").isNull()).otherwise(True).alias("matches"),
        F.concat_ws(", ", kind, status, "target_text").alias("intent"))


@query(f"""WITH {rows_sql(_MERGED)} SELECT doc_id, CASE WHEN ok THEN value_text END AS value_text, CASE WHEN ok THEN list_value('kept') ELSE list_value('kept', 'value dropped') END AS flags
FROM (SELECT *, COALESCE(contains(text, value_text), false) AND value_provenance <> 'guess' AS ok FROM r) WHERE value_status = 'complete'""")
def silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rows with untrusted values set to null and flagged."""
    ok = F.coalesce(F.contains("text", "value_text"), F.lit(False)) & (F.col("value_provenance") != "guess")
    told = rows(spark, sf_dir, _MERGED).where("value_status = 'complete'").withColumn("ok", ok)
    return told.select("doc_id", F.when(F.col("ok"), F.col("value_text")).alias("value_text"), F.when(F.col("ok"), F.array(F.lit("kept"))).otherwise(F.array(F.lit("kept"), F.lit("value dropped"))).alias("flags"))


def strip_private(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


@query("""SELECT doc_id, lang FROM documents""")
def public_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without private columns."""
    return strip_private(table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source").alias("_source"), F.lit(1).alias("_rank")))


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
w AS (SELECT *, list_filter(string_split(lower(line), ' '), lambda x: x <> '') AS ws FROM l)
SELECT doc_id, line_no::INT AS line_no, list_contains(ws, 'the') OR list_contains(ws, 'der') AS has_word, len(regexp_extract_all(line, '(?:^|[^A-Za-z])(?:the|The)\b')) > 1 AS again,
  regexp_matches(line, '(?:^|\s)(?:Mr|Dr|Herr|Mme)\.? [A-Z]') AS title, len(ws) > 0 AND len(list_filter(regexp_extract_all(line, '[A-Za-z]+'), lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0 AS capitalised,
  regexp_matches(line, '[\x{200B}-\x{200F}\x{2028}-\x{202E}\x{00A0}…‽•]') AS odd FROM w""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on lines: a word among the words, a word again, a title before a name, capitals alone, unusual characters."""
    from inkwell.plans.text_queries import lines

    line = F.col("line")
    ws = F.filter(F.split(F.lower(line), " "), lambda w: w != "")
    letters = F.regexp_extract_all(line, F.lit("[A-Za-z]+"), 0)
    return lines(spark, sf_dir).select(
        "doc_id", "line_no", (F.array_contains(ws, "the") | F.array_contains(ws, "der")).alias("has_word"), (F.regexp_count(line, F.lit(r"(?:^|[^A-Za-z])(?:the|The)\b")) > 1).alias("again"),
        line.rlike(r"(?:^|\s)(?:Mr|Dr|Herr|Mme)\.? [A-Z]").alias("title"), ((F.size(ws) > 0) & (F.size(F.filter(letters, lambda w: ~w.rlike("^[A-Z]"))) == 0)).alias("capitalised"),
        line.rlike(r"[​-‏ -‮ …‽•]").alias("odd"))

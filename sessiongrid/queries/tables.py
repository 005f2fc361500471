"""Sources, projections, cleaning, scalar functions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessiongrid import catalog
from sessiongrid.functions import clock, text, vectors
from sessiongrid.operators import align, clean, rank, sampling
from sessiongrid.operators.annotations import label_rows
from sessiongrid.queries.base import SESSIONS_SQL, load, query, sessions
from sessiongrid.session import new_path
from sessiongrid.sources import captions, keypoints, metric_files, store, tables as table_source

JOINTS = tuple(f"j{i}" for i in range(21))


@query("""
SELECT vec_id, embedding[1]::DOUBLE AS j0_x, embedding[2]::DOUBLE AS j0_y, embedding[3]::DOUBLE AS j0_c,
       embedding[61]::DOUBLE AS j20_x, embedding[62]::DOUBLE AS j20_y, embedding[63]::DOUBLE AS j20_c FROM embeddings""")
def keypoint_columns(spark, sf_dir):
    """A flat x, y, confidence array to named columns, for chosen joints."""
    vectors_ = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("keypoints"))
    return keypoints.flatten_keypoints(vectors_, joints=("j0", "j20"), order=JOINTS)


@query("""
SELECT conv_id::VARCHAR AS participant, turn // 4 AS part, (row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn))::INTEGER AS seq,
       turn * 60.5::DOUBLE AS start_time, turn * 60.5::DOUBLE + 1 AS end_time, role AS text FROM conversations""")
def caption_cues(spark, sf_dir):
    """Caption texts made of four conversation turns each, a cue per turn, parsed back to timed rows."""
    seconds = lambda c: F.concat(
        F.lit("00:"), F.lpad(F.floor(c / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.format_number(c - F.floor(c / 60) * 60, 3), 6, "0"),
    )
    start = F.col("turn") * F.lit(60.5)
    cue = F.concat(seconds(start), F.lit(" --> "), seconds(start + 1), F.lit("\nSPEAKER 01:"), F.col("role"))
    documents = (
        load(spark, sf_dir, "conversations")
        .select(
            F.col("conv_id").cast("string").alias("participant"), F.floor(F.col("turn") / 4).alias("part"),
            F.struct("turn", cue.alias("cue")).alias("c"),
        )
        .groupBy("participant", "part")
        .agg(F.concat_ws("\n\n", F.lit("WEBVTT"), F.sort_array(F.collect_list("c"))["cue"]).alias("content"))
    )
    return captions.parse_captions(documents, keep=["participant", "part"])


@query("""
SELECT conv_id, 'c' || conv_id AS file, role AS speaker, turn * 2.5::DOUBLE AS start, turn * 2.5::DOUBLE + 1.25 AS "end", 1.25::DOUBLE AS duration
FROM conversations""")
def turn_lines(spark, sf_dir):
    """Diarisation lines made of conversation turns, parsed back to turns."""
    line = F.concat(
        F.lit("SPEAKER c"), F.col("conv_id"), F.lit(" 1 "), F.col("turn") * F.lit(2.5), F.lit("  1.25 <NA> <NA> "),
        F.col("role"), F.lit(" <NA> <NA>"),
    )
    lines = load(spark, sf_dir, "conversations").select("conv_id", line.alias("value"))
    return captions.parse_turns(lines, keep=["conv_id"])


@query("""
SELECT source AS file, 'chars_' || lang AS metric, -(n_chars / 8.0)::DOUBLE AS value FROM documents""")
def metric_lines(spark, sf_dir):
    line = F.concat(F.lit("chars_"), F.col("lang"), F.lit(": "), -(F.col("n_chars") / F.lit(8.0)))
    noise = F.lit("=" * 50)
    lines = load(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.explode(F.array(line, noise)).alias("value"))
    return metric_files.parse_metric_lines(lines)


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]*$', '') AS participant FROM pages""")
def entity_from_path(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"))
    return table_source.entity_of_file_column(pages).drop("file")


@query("""SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def pending_work(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return store.pending(documents, load(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT l.doc_id, l.quality, e.embedding[1]::DOUBLE AS f_0 FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id""")
def vector_lookup(spark, sf_dir):
    """Stored vectors of wanted keys."""
    wanted = load(spark, sf_dir, "labels").select("doc_id", "quality")
    vectors_ = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.get("embedding", 0).cast("double").alias("f_0"))
    return align.left_align(wanted, vectors_, ["doc_id"])


@query("""SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def csv_files(spark, sf_dir):
    """A table written as CSV files and read back by name with declared types."""
    path = new_path(spark)
    store.write_frames(load(spark, sf_dir, "customer"), path, file_format="csv")
    types = {"c_custkey": T.LongType(), "c_name": T.StringType(), "c_acctbal": T.DoubleType(), "c_mktsegment": T.StringType()}
    return table_source.read_table(spark, path, table_source.declared(**types))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer""")
def csv_column_orders(spark, sf_dir):
    """Files of one table whose headers differ in order and in columns, read back by name."""
    path = new_path(spark)
    customers = load(spark, sf_dir, "customer")
    orders = [["c_custkey", "c_name", "c_acctbal"], ["c_acctbal", "c_mktsegment", "c_name", "c_custkey"]]
    for i, names in enumerate(orders):
        store.write_frames(customers.where(F.col("c_custkey") % 2 == i).select(names), f"{path}/{i}", file_format="csv")
    types = {"c_custkey": T.LongType(), "c_name": T.StringType(), "c_acctbal": T.DoubleType()}
    return table_source.read_table(spark, [f"{path}/0", f"{path}/1"], table_source.declared(**types))


@query("""SELECT s_nationkey AS nation, count(*)::BIGINT AS n FROM supplier GROUP BY s_nationkey""")
def entity_folders(spark, sf_dir):
    """A table written in a folder per entity and read back with the entity."""
    path = new_path(spark)
    suppliers = load(spark, sf_dir, "supplier").withColumn("nation", F.col("s_nationkey"))
    store.write_frames(suppliers, path, ["nation"])
    return spark.read.parquet(path).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_linenumber AS fold, l_returnflag AS metric, min(l_extendedprice) AS value FROM lineitem GROUP BY l_linenumber, l_returnflag""")
def metric_folders(spark, sf_dir):
    """Metrics written as text lines in a folder per fold, then read and parsed."""
    path = new_path(spark)
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("metric"))
    metric_files.write_metric_files(lines.agg(F.min("l_extendedprice").alias("value")), path)
    read = metric_files.read_metric_files(spark, path)
    fold = F.regexp_extract("file", "fold=([0-9]+)", 1).cast("int").alias("fold")
    return read.select(fold, "metric", "value")


@query("""SELECT l.doc_id, e.embedding[2]::DOUBLE AS f_1 FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id""")
def vector_store(spark, sf_dir):
    """Vectors written to a store and fetched for wanted keys."""
    path = new_path(spark)
    vectors_ = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    store.write_vectors(vectors_, path, ["doc_id"], "embedding")
    found = store.read_vectors(spark, path, load(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])
    return found.select("doc_id", F.get("embedding", 1).cast("double").alias("f_1"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem""")
def keep_listed(spark, sf_dir):
    return catalog.keep_features(load(spark, sf_dir, "lineitem"), [" l_tax", "l_quantity", "absent"], ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_discount, l_tax, l_shipdate FROM lineitem""")
def regex_columns(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    names = catalog.matching_names(lines, r"^l_(dis|tax|ship)", r"mode$")
    return catalog.select_names(lines, ["l_orderkey", "l_linenumber", *names])


LINE_GROUPS = {"audio": ["l_tax"], "facial": ["l_discount"], "gaze": ["l_extendedprice"], "pose": ["l_quantity"]}


@query("""SELECT l_orderkey, l_linenumber, l_discount, l_extendedprice, l_quantity FROM lineitem""")
def modality_flags(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber"]
    return catalog.select_by_flags(load(spark, sf_dir, "lineitem"), False, True, True, None, LINE_GROUPS, keys)


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def modality_text(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber"]
    return catalog.select_modalities(load(spark, sf_dir, "lineitem"), "pose_audio", ["l_quantity"], LINE_GROUPS, keys)


@query("""SELECT p_partkey, p_size, p_retailprice FROM part""")
def numeric_columns(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    return catalog.select_names(parts, catalog.numeric_names(parts))


@query("""SELECT c_nationkey AS nation, c_custkey AS id, c_name, c_acctbal, c_mktsegment, 0 AS binary_label, 0 AS multiclass_label FROM customer""")
def shaped_columns(spark, sf_dir):
    """Constant labels, new names, keys first."""
    labelled = clean.add_constants(load(spark, sf_dir, "customer"), {"binary_label": 0, "multiclass_label": 0})
    renamed = labelled.withColumnsRenamed({"c_nationkey": "nation", "c_custkey": "id"})
    return clean.reorder(renamed, ["nation", "id", "binary_label", "multiclass_label"])


def _holes(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(q > 45, None).when(q < 3, F.lit(float("nan"))).otherwise(q).alias("a"),
        F.when(d > 0.08, F.lit(float("-inf"))).otherwise(d).alias("b"),
    )


HOLES_SQL = """ho AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity < 3 THEN 'nan'::DOUBLE ELSE l_quantity END AS a,
  CASE WHEN l_discount > 0.08::DOUBLE THEN '-inf'::DOUBLE ELSE l_discount END AS b FROM lineitem)"""


@query(f"""WITH {HOLES_SQL}
SELECT 'a' AS "column", count_if(a IS NULL OR isnan(a))::BIGINT AS n_missing, count_if(isinf(a))::BIGINT AS n_infinite FROM ho
UNION ALL SELECT 'b', count_if(b IS NULL OR isnan(b))::BIGINT, count_if(isinf(b))::BIGINT FROM ho""")
def null_inf_audit(spark, sf_dir):
    return clean.audit_missing(_holes(spark, sf_dir), ["a", "b"])


@query(f"""WITH {HOLES_SQL}
SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL OR NOT isfinite(a) THEN 0 ELSE a END AS a,
       CASE WHEN b IS NULL OR NOT isfinite(b) THEN 0 ELSE b END AS b FROM ho""")
def fill_nonfinite(spark, sf_dir):
    return clean.fill_nonfinite(_holes(spark, sf_dir), ["a", "b"])


@query(f"""WITH {HOLES_SQL} SELECT l_orderkey, l_linenumber, a, b FROM ho WHERE a IS NOT NULL AND NOT isnan(a)""")
def drop_missing(spark, sf_dir):
    return clean.drop_missing(_holes(spark, sf_dir), ["a"])


@query("""SELECT doc_id, TRY_CAST(trim(text) AS DOUBLE) AS number, n_chars::DOUBLE AS n_chars FROM documents""")
def coerce_numeric(spark, sf_dir):
    texts = load(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("number"), F.concat(F.lit(" "), F.col("n_chars")).alias("n_chars")
    )
    return clean.coerce_numeric(texts, ["number", "n_chars"])


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'click' ELSE event_type END AS event_type
FROM events WHERE event_type NOT IN ('view', 'signup')""")
def merged_classes(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    return clean.merge_class(clean.exclude_classes(events, "event_type", ["view", "signup"]), "event_type", "purchase", "click")


@query("""SELECT e.event_id, coalesce(l.quality::VARCHAR, '') AS quality FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id""")
def blank_text(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), "quality")
    return clean.blank_missing_text(align.left_align(events, labels, ["event_id"]), ["quality"])


@query(f"""WITH {SESSIONS_SQL}, f AS (SELECT user_id, min(us) AS first FROM ev GROUP BY user_id),
n AS (SELECT user_id, row_number() OVER (ORDER BY first, user_id) - 1 AS entity_no FROM f)
SELECT ev.user_id, ev.event_id, n.entity_no FROM ev JOIN n ON n.user_id = ev.user_id""")
def entity_numbers(spark, sf_dir):
    return align.dense_entity_number(sessions(spark, sf_dir), "user_id", ["us"]).select("user_id", "event_id", "entity_no")


LABEL_WORDS = ("click", "view", "error")
LABELS_SQL = """la AS (SELECT event_id, event_type || ', ' || CASE WHEN value > 20 THEN 'view' ELSE 'slow' END || ',' || event_type AS labels FROM events)"""


def _labelled(spark, sf_dir):
    speed = F.when(F.col("value") > 20, "view").otherwise("slow")
    joined = F.concat(F.lit('"'), F.col("event_type"), F.lit(", "), speed, F.lit(","), F.col("event_type"), F.lit('"'))
    return load(spark, sf_dir, "events").select("event_id", joined.alias("labels"))


@query(f"""WITH {LABELS_SQL}, ex AS (SELECT event_id, trim(unnest(string_split(labels, ','))) AS labels FROM la)
SELECT event_id, labels FROM ex WHERE labels IN ('click', 'view', 'error')""")
def explode_labels(spark, sf_dir):
    return label_rows(_labelled(spark, sf_dir), vocabulary=LABEL_WORDS)


@query(f"""WITH {LABELS_SQL}, ex AS (SELECT event_id, trim(unnest(string_split(labels, ','))) AS labels FROM la),
k AS (SELECT event_id, labels FROM ex WHERE labels IN ('click', 'view', 'error'))
SELECT la.event_id, k.labels FROM la LEFT JOIN k ON k.event_id = la.event_id""")
def explode_labels_keeping_empty(spark, sf_dir):
    return label_rows(_labelled(spark, sf_dir), vocabulary=LABEL_WORDS, keep_empty=True)


@query(f"""WITH {LABELS_SQL}, ex AS (SELECT event_id, trim(unnest(string_split(labels, ','))) AS labels FROM la)
SELECT event_id, CASE WHEN labels IN ('click', 'view', 'error') THEN labels ELSE 'other' END AS labels FROM ex""")
def other_bucket(spark, sf_dir):
    return label_rows(_labelled(spark, sf_dir), vocabulary=LABEL_WORDS, to_other=True)


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'look' WHEN event_type IN ('purchase', 'signup') THEN 'act' END AS category FROM events""")
def label_category(spark, sf_dir):
    categories = {"look": ("click", "view"), "act": ("purchase", "signup")}
    return load(spark, sf_dir, "events").select("event_id", text.category_of(F.col("event_type"), categories).alias("category"))


@query("""SELECT event_id, floor(((extract('hour' FROM ts) * 60 + extract('minute' FROM ts)) * 60
  + (extract('microsecond' FROM ts) / 1000000.0::DOUBLE)) * 29.97::DOUBLE)::INTEGER AS frame FROM events""")
def clock_to_frame(spark, sf_dir):
    stamp = F.concat(F.lit("0 days "), F.date_format("ts", "HH:mm:ss.SSSSSS"))
    return load(spark, sf_dir, "events").select("event_id", clock.clock_to_frame(stamp).alias("frame"))


@query(f"""WITH {SESSIONS_SQL} SELECT event_id, k / 30.0::DOUBLE AS seconds, trunc(value * 1000)::BIGINT AS ms FROM ev""")
def frame_seconds(spark, sf_dir):
    return sessions(spark, sf_dir).select(
        "event_id", clock.frame_to_seconds(F.col("k")).alias("seconds"), clock.seconds_to_ms(F.col("value")).alias("ms")
    )


@query("""SELECT user_id, CASE WHEN user_id % 2 = 0 THEN user_id || '' || (user_id + 1) || '_0'
  ELSE (user_id - 1) || '' || user_id || '_1' END AS session_id, count(*)::BIGINT AS n FROM events GROUP BY user_id""")
def pair_session(spark, sf_dir):
    users = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.withColumn("session_id", text.pair_session_id(F.col("user_id")))


@query(f"""WITH {SESSIONS_SQL} SELECT event_id, list_sum([value, k]) AS total, 2 AS n FROM ev""")
def array_literals(spark, sf_dir):
    """Number lists written as text, read back as arrays."""
    written = F.concat(F.lit("["), F.col("value"), F.lit(", "), F.col("k"), F.lit("]"))
    numbers = text.array_literal(written)
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return sessions(spark, sf_dir).select("event_id", total.alias("total"), F.size(numbers).alias("n"))


@query("""SELECT doc_id, string_split(text, ':')[-1] AS said FROM documents""")
def after_last_colon(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.after_last_colon(F.col("text")).alias("said"))


@query("""SELECT s_suppkey, CASE WHEN abs(s_acctbal) / 10000 < 0.001 THEN '***' WHEN abs(s_acctbal) / 10000 < 0.01 THEN '**'
  WHEN abs(s_acctbal) / 10000 < 0.05 THEN '*' ELSE 'N.S.' END AS mark FROM supplier""")
def stars(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.stars(F.abs("s_acctbal") / 10000).alias("mark"))


@query("""SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best,
  CASE WHEN embedding[1] > 0.05 THEN 1 ELSE 0 END AS over FROM embeddings""")
def argmax_threshold(spark, sf_dir):
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.argmax(v).alias("best"), vectors.threshold_class(F.get(v, 0), 0.05).alias("over")
    )


@query("""SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE + embedding[5]::DOUBLE) / 3, 9) AS f_0,
  round((embedding[2]::DOUBLE + embedding[4]::DOUBLE + embedding[6]::DOUBLE) / 3, 9) AS f_1 FROM embeddings""")
def mean_vectors(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    mean = vectors.mean_vector([F.slice(v, i, 2) for i in (1, 3, 5)])
    return load(spark, sf_dir, "embeddings").select("vec_id", *[F.round(F.get(mean, i), 9).alias(f"f_{i}") for i in (0, 1)])


@query("""SELECT vec_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), '') AS code FROM embeddings""")
def one_hot(spark, sf_dir):
    code = F.transform(vectors.one_hot(F.col("label"), 10), lambda x: x.cast("int").cast("string"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.array_join(code, "").alias("code"))


@query("""SELECT vec_id, 66 AS n, round((embedding[64]::DOUBLE - 0.5) / 0.5, 9) AS last_value, round((0 - 0.5) / 0.5::DOUBLE, 9) AS padding FROM embeddings""")
def padded_vector(spark, sf_dir):
    fitted = vectors.affine(vectors.fit_length(F.col("embedding").cast("array<double>"), 66), 0.5, 0.25)
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(fitted).alias("n"), F.round(F.get(fitted, 63), 9).alias("last_value"), F.round(F.get(fitted, 65), 9).alias("padding")
    )


@query("""SELECT vec_id, embedding[1]::DOUBLE AS f_0, embedding[2]::DOUBLE AS f_1, embedding[3]::DOUBLE AS f_2 FROM embeddings""")
def vector_columns(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return load(spark, sf_dir, "embeddings").select("vec_id", *vectors.to_columns(v, 3))


@query("""SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier""")
def union_all(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = load(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return align.union_all([customers, suppliers])


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def set_diff(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey")
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return align.missing_keys(customers, urgent.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT quality AS class FROM labels UNION SELECT toxic FROM labels""")
def distinct_classes(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    return labels.select(F.col("quality").alias("class")).union(labels.select("toxic")).distinct()


@query("""SELECT c_nationkey, c_acctbal, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey""")
def multi_sort(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey")
    return customers.orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey")


@query("""SELECT user_id, (row_number() OVER (ORDER BY md5(user_id || '|42'), user_id) - 1)::BIGINT AS place FROM (SELECT DISTINCT user_id FROM events)""")
def seeded_shuffle(spark, sf_dir):
    users = load(spark, sf_dir, "events").select("user_id").distinct()
    return sampling.hash_ranked(users, [], ["user_id"], 42, "place")


@query(f"""WITH {SESSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT user_id, event_id FROM r WHERE p < floor(n * 0.6::DOUBLE)""")
def first_share(spark, sf_dir):
    rows = sessions(spark, sf_dir).select("user_id", "us", "event_id")
    return rank.first_share(rows, ["user_id"], ["us", "event_id"], 0.6).drop("us")

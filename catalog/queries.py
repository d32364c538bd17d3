"""The registered queries: each runs one operator over a whole table, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import layerstack as op
from catalog import oracles as o
from catalog.session import scratch, ship
from layerstack import (
    StackedAutoencoder,
    StackedAutoencoderModel,
    check_gradients,
    summarize_check,
)
from layerstack import functions as fn
from layerstack.operators.gradients import direction
from layerstack.operators.randoms import fixed_mask
from layerstack.operators.rules import Rules
from layerstack.operators.slices import initial_units
from layerstack.plans.blocked import fit_blocked
from layerstack.plans.update import initial_decoder, initial_encoder
from layerstack.sources import import_text, read_features, text_lines, write_libsvm
from layerstack.streaming import score_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EMBEDDING = {"featuresCol": "embedding", "idCols": ["vec_id"]}
LINE = {"inputCols": o.LINE_COLUMNS}
STANDARD = Rules.of("standard")
BETA = 0.05


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """A file stream of a table that is one parquet file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if files.exists(where) and files.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    # A stream starts at a folder, so a single file is picked from the one it lies in.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def r6(column, digits: int = 6):
    return F.round(column, digits)


def start_model(df: DataFrame, hidden: list[int], **options) -> StackedAutoencoderModel:
    """Start weights, with ranges from the table."""
    return StackedAutoencoder(hidden=hidden, epochs=0, **options).fit(df)


def start_tables(sql: o.Sql, sizes: list[int], semantics: str = "standard") -> list:
    names = []
    for layer, (n, k) in enumerate(zip(sizes, sizes[1:]), 1):
        w = initial_encoder(n, k, Rules.of(semantics), 0, layer)
        names.append((sql.add(f"w{layer}", o.matrix_values(w)),
                      sql.add(f"s{layer}", o.matrix_values(initial_decoder(w)))))
    return names


# --- scalar functions ------------------------------------------------------------------------

_Z = "(l_discount - 0.05) * 60 + (l_tax - 0.04) * 20"
_ACTIVATION_SQL = {
    "sigmoid": "1e0 / (1e0 + exp(-z))",
    "dsigmoid": "(1e0 / (1e0 + exp(-z))) * (1e0 - 1e0 / (1e0 + exp(-z)))",
    "tanh": "1e0 - 2e0 / (exp(2e0 * z) + 1e0)",
    "dtanh": "1e0 - pow(1e0 - 2e0 / (exp(2e0 * z) + 1e0), 2)",
    "relu": "greatest(0e0, z)",
    "drelu": "CASE WHEN z >= 0 THEN 1e0 ELSE 0e0 END",
    "lrelu": "CASE WHEN z >= 0 THEN z ELSE 0.01e0 * z END",
    "dlrelu": "CASE WHEN z >= 0 THEN 1e0 ELSE 0.01e0 END",
    "elu": "CASE WHEN z >= 0 THEN z ELSE 0.05e0 * (exp(z) - 1e0) END",
    "delu": "CASE WHEN z >= 0 THEN 1e0 ELSE 0.05e0 * exp(z) END",
}


def _activation_oracle() -> str:
    sql = o.Sql()
    sql.add("t", "SELECT l_orderkey, l_linenumber, (l_discount - 5e-2) * 6e1 + (l_tax - 4e-2) * 2e1 "
                 "AS z FROM lineitem")
    columns = ", ".join(f"{o.rounded(e)} AS {c}" for c, e in _ACTIVATION_SQL.items())
    clamp = "greatest(least(z, 1e0 - 1e-14), 1e-14)"
    return sql.render(
        f"SELECT l_orderkey, l_linenumber, {columns}, {o.rounded(clamp)} AS clamped FROM t"
    )


@register("activations", _activation_oracle())
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (F.col("l_discount") - 0.05) * 60.0 + (F.col("l_tax") - 0.04) * 20.0
    pairs = {name: (f, df) for name, (f, df) in fn.ACTIVATIONS.items()}
    columns = []
    for name, (f, df) in pairs.items():
        columns += [r6(f("z")).alias(name), r6(df("z")).alias(f"d{name}")]
    return (
        lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", z.alias("z"))
        .select("l_orderkey", "l_linenumber", *columns,
                r6(fn.clamp_probability("z")).alias("clamped"))
    )


_ODD_Z = (
    "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN CAST('NaN' AS DOUBLE) "
    "ELSE (l_discount - 5e-2) * 6e1 + (l_tax - 4e-2) * 2e1 END"
)


def _nulls_oracle() -> str:
    """Formulas of floating point: NaN is neither at least 0 nor below, and stays in sums."""
    sql = o.Sql()
    sql.add("t", f"SELECT l_orderkey, l_linenumber, {_ODD_Z} AS z FROM lineitem")
    at_nan = {"drelu": "0e0", "dlrelu": "0.01e0"}
    clamp = "greatest(least(z, 1e0 - 1e-14), 1e-14)"
    columns = []
    for name, body in [*_ACTIVATION_SQL.items(), ("clamped", clamp)]:
        nan = at_nan.get(name, "-999e0")
        columns.append(
            f"CASE WHEN z IS NULL THEN NULL WHEN isnan(z) THEN {nan} ELSE {o.rounded(body)} END "
            f"AS {name}"
        )
    return sql.render(f"SELECT l_orderkey, l_linenumber, {', '.join(columns)} FROM t")


@register("activations_nulls", _nulls_oracle())
def activations_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalar functions with nulls and NaN among the values; NaN results are shown as -999."""
    shown = lambda c: F.when(F.isnan(c), -999.0).otherwise(r6(c))
    columns = []
    for name, (f, df) in fn.ACTIVATIONS.items():
        columns += [shown(f("z")).alias(name), shown(df("z")).alias(f"d{name}")]
    columns.append(shown(fn.clamp_probability("z")).alias("clamped"))
    table = lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", F.expr(_ODD_Z).alias("z"))
    return table.select("l_orderkey", "l_linenumber", *columns)


_ODD_P = (
    "CASE WHEN l_linenumber = 1 THEN 0e0 WHEN l_linenumber = 2 THEN 1e0 "
    "ELSE avg(l_discount) * 5e0 END"
)


def _saturated_oracle() -> str:
    sql = o.Sql()
    sql.add("t", f"SELECT l_linenumber AS unit, {_ODD_P} AS p FROM lineitem GROUP BY l_linenumber")
    sql.add("c", "SELECT unit, p, greatest(least(p, 1e0 - 1e-14), 1e-14) AS c FROM t")
    kl = "5e-2 * ln(5e-2 / c) + 0.95e0 * ln(0.95e0 / (1e0 - c))"
    pull = "ln(1e0 + abs(0.95e0 / (1e0 - c) - 5e-2 / c))"
    return sql.render(
        f"SELECT unit, {o.rounded(kl)} AS kl, {o.rounded(pull)} AS pull, "
        "p = 0 OR p = 1 AS infinite FROM c"
    )


@register("kl_saturated", _saturated_oracle())
def kl_saturated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparsity terms of units of which some are dead or saturated, with and without the guard."""
    units = lineitem(spark, sf_dir).groupBy(F.col("l_linenumber").alias("unit")).agg(
        F.expr(_ODD_P).alias("p")
    )
    infinite = F.abs(fn.kl_gradient("p", 0.05, guard=False)) == float("inf")
    return units.select(
        "unit", r6(fn.kl_term("p", 0.05)).alias("kl"),
        r6(F.log(1 + F.abs(fn.kl_gradient("p", 0.05)))).alias("pull"),
        ((fn.kl_term("p", 0.05, guard=False) == float("inf")) & infinite).alias("infinite"),
    )


def _array_oracle() -> str:
    sql = o.Sql()
    o.embeddings_raw(sql)
    return sql.render(
        f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS pos, {o.rounded(o.sigmoid('v'))} AS s, "
        f"{o.rounded('greatest(0e0, v)')} AS r FROM raw"
    )


@register("activations_over_arrays", _array_oracle())
def activations_over_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.arrays_zip(
        fn.over_array(fn.sigmoid, F.col("embedding").cast("array<double>")).alias("s"),
        fn.over_array(fn.relu, F.col("embedding").cast("array<double>")).alias("r"),
    )
    return (
        embeddings(spark, sf_dir).select("vec_id", F.posexplode(both).alias("pos", "v"))
        .select("vec_id", "pos", r6("v.s").alias("s"), r6("v.r").alias("r"))
    )


def _bias_oracle() -> str:
    return (
        "SELECT vec_id, CAST(len(embedding) + 1 AS INTEGER) AS width, 1e0 AS first, "
        "CAST(len(embedding) AS INTEGER) AS width_again, "
        f"{o.rounded('1e0 + list_sum(list_transform(embedding, lambda v: v::DOUBLE))')} AS total "
        "FROM embeddings"
    )


@register("bias_augment", _bias_oracle())
def bias_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    biased = fn.with_bias(F.col("embedding").cast("array<double>"))
    total = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v)
    return embeddings(spark, sf_dir).select("vec_id", biased.alias("x")).select(
        "vec_id",
        F.size("x").alias("width"),
        F.element_at("x", 1).alias("first"),
        F.size(fn.without_bias("x")).alias("width_again"),
        r6(total).alias("total"),
    )


# --- profile, scaling, validation, corruption ------------------------------------------------


def _profile_oracle(table: str) -> str:
    sql = o.Sql()
    (o.embeddings_raw if table == "embeddings" else o.lineitem_raw)(sql)
    return sql.render(
        "SELECT CAST(i - 1 AS INTEGER) AS feature, min(v) AS lo, max(v) AS hi, count(v) AS n, "
        "count(*) - count(v) AS bad FROM raw GROUP BY i UNION ALL "
        f"SELECT -1, NULL, NULL, count(*), 0 FROM {table}"
    )


@register("feature_profile", _profile_oracle("embeddings"))
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.feature_profile(embeddings(spark, sf_dir), "embedding")


@register("feature_profile_columns", _profile_oracle("lineitem"))
def feature_profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.feature_profile(lineitem(spark, sf_dir), o.LINE_COLUMNS)


def _validate_oracle() -> str:
    sql = o.Sql()
    o.embeddings_raw(sql)
    return sql.render(
        "SELECT (SELECT count(*) FROM embeddings) AS rows, "
        "(SELECT count(*) - count(embedding) FROM embeddings) AS null_rows, "
        "(SELECT CAST(min(len(embedding)) AS INTEGER) FROM embeddings) AS min_width, "
        "(SELECT CAST(max(len(embedding)) AS INTEGER) FROM embeddings) AS max_width, "
        "(SELECT count(*) - count(v) FROM raw) AS bad_values, "
        "(SELECT count(*) FROM raw WHERE v < 0 OR v > 1) AS outside"
    )


@register("validate_features", _validate_oracle())
def validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.validate_features(embeddings(spark, sf_dir), "embedding")


def _scaled_oracle(table: str) -> str:
    sql, _ = o.source(table)
    if table != "lineitem":
        return sql.render(
            f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS pos, {o.rounded('v')} AS v FROM x1"
        )
    return sql.render(
        "SELECT l_orderkey, l_linenumber, CAST(i - 1 AS INTEGER) AS pos, "
        f"{o.rounded('v')} AS v FROM x1 JOIN li USING (id)"
    )


@register("scale_minmax", _scaled_oracle("embeddings"))
def scale_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.scale_minmax(embeddings(spark, sf_dir), "embedding")
    return df.select("vec_id", F.posexplode("scaled").alias("pos", "v")).withColumn("v", r6("v"))


@register("scale_columns", _scaled_oracle("lineitem"))
def scale_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.scale_minmax(lineitem(spark, sf_dir), o.LINE_COLUMNS)
    return df.select(
        "l_orderkey", "l_linenumber", F.posexplode("scaled").alias("pos", "v")
    ).withColumn("v", r6("v"))


def _corrupt_fixed_oracle() -> str:
    sql = o.Sql()
    o.embeddings_raw(sql)
    sql.add("m", f"SELECT i, v AS k FROM ({o.vector_values(fixed_mask(64))})")
    return sql.render(
        f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS pos, {o.rounded('v * k')} AS v "
        "FROM raw JOIN m USING (i)"
    )


@register("corrupt_fixed", _corrupt_fixed_oracle())
def corrupt_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.corrupt_fixed(embeddings(spark, sf_dir), "embedding", 64)
    return df.select("vec_id", F.posexplode("corrupted").alias("pos", "v")).withColumn("v", r6("v"))


def _corrupt_oracle() -> str:
    sql = o.Sql()
    o.embeddings_raw(sql)
    o.hashed_mask(sql, "hm", 64, 2, 3, 11, 0.3)
    return sql.render(
        f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS pos, {o.rounded('v * k')} AS v "
        "FROM raw JOIN hm USING (id, i)"
    )


@register("corrupt_hashed", _corrupt_oracle())
def corrupt_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = op.corrupt(
        embeddings(spark, sf_dir), "embedding", ids=["vec_id"], drop=0.3, seed=11, layer=2, epoch=3
    )
    return df.select("vec_id", F.posexplode("corrupted").alias("pos", "v")).withColumn("v", r6("v"))


# --- encode, decode, score -------------------------------------------------------------------


def _long(df: DataFrame, keys: list[str], vector: str, pos: str, value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias(pos, value)).withColumn(value, r6(value))


def _encode_oracle(table: str, hidden: list[int], upto: int, activation="sigmoid",
                   semantics="standard", method="regular") -> str:
    sql, n = o.source(table)
    sizes = [n, *hidden]
    tables = start_tables(sql, sizes, semantics)
    x = "x1"
    for layer in range(1, upto + 1):
        mask = None
        if semantics == "reference" and method == "denoising":
            values = o.vector_values(fixed_mask(sizes[layer - 1]))
            mask = sql.add(f"fm{layer}", f"SELECT i, v AS k FROM ({values})")
        x = o.forward(sql, f"c{layer}", x, tables[layer - 1][0], mask, activation)
    if table != "lineitem":
        return sql.render(
            f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS unit, {o.rounded('v')} AS a FROM {x}"
        )
    return sql.render(
        "SELECT l_orderkey, l_linenumber, CAST(i - 1 AS INTEGER) AS unit, "
        f"{o.rounded('v')} AS a FROM {x} JOIN li USING (id)"
    )


@register("encode_1", _encode_oracle("embeddings", [8, 4], 1))
def encode_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8, 4], method="regular", **EMBEDDING)
    return _long(model.encode(df, upto=1), ["vec_id"], "code", "unit", "a")


@register("encode_2", _encode_oracle("embeddings", [8, 4], 2))
def encode_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8, 4], method="regular", **EMBEDDING)
    return _long(model.transform(df), ["vec_id"], "code", "unit", "a")


@register("encode_masked",
          _encode_oracle("embeddings", [8, 4], 2, semantics="reference", method="denoising"))
def encode_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8, 4], method="denoising", semantics="reference", **EMBEDDING)
    return _long(model.encode(df), ["vec_id"], "code", "unit", "a")


@register("encode_columns", _encode_oracle("lineitem", [3, 2], 2))
def encode_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    model = start_model(df, [3, 2], method="regular", **LINE)
    return _long(model.encode(df), ["l_orderkey", "l_linenumber"], "code", "unit", "a")


def _register_activation(name: str) -> None:
    @register(f"encode_{name}", _encode_oracle("embeddings", [6], 1, name))
    def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = embeddings(spark, sf_dir)
        model = start_model(df, [6], method="regular", activation=name, **EMBEDDING)
        return _long(model.encode(df), ["vec_id"], "code", "unit", "a")


for _name in ("tanh", "relu", "lrelu", "elu"):
    _register_activation(_name)


def _layer(table: str, k: int, method: str, semantics: str = "standard", tied: bool = False,
           beta: float = BETA, activation: str = "sigmoid") -> tuple[o.Sql, o.Layer]:
    """The first pass over the first layer."""
    sql, n = o.source(table)
    (w, s), = start_tables(sql, [n, k], semantics)
    mask = None
    if method == "denoising" and semantics == "reference":
        mask = sql.add("fm", f"SELECT i, v AS k FROM ({o.vector_values(fixed_mask(n))})")
    elif method == "denoising":
        mask = o.hashed_mask(sql, "hm", n, 1, 0, 0, 0.5)
    layer = o.Layer(
        sql, "q", "x1", n, w, s, method, semantics, mask, tied, 0.05, beta, activation
    )
    return sql, layer


def _reconstruct_oracle() -> str:
    sql, layer = _layer("embeddings", 8, "regular")
    return sql.render(
        f"SELECT id AS vec_id, CAST(g AS INTEGER) AS pos, {o.rounded('p')} AS v FROM {layer.out}"
    )


@register("reconstruct", _reconstruct_oracle())
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8], method="regular", **EMBEDDING)
    return _long(model.reconstruct(df), ["vec_id"], "reconstruction", "pos", "v")


def _reconstruct_2_oracle() -> str:
    sql, n = o.source("embeddings")
    (w1, s1), (w2, s2) = start_tables(sql, [n, 8, 4])
    x = o.forward(sql, "c1", "x1", w1)
    x = o.forward(sql, "c2", x, w2)
    x = o.forward(sql, "d2", x, s2)
    x = o.forward(sql, "d1", x, s1)
    return sql.render(
        f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS pos, {o.rounded('lo + v * (hi - lo)')} AS v "
        f"FROM {x} JOIN rng USING (i)"
    )


@register("reconstruct_stack", _reconstruct_2_oracle())
def reconstruct_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8, 4], method="regular", **EMBEDDING)
    return _long(model.reconstruct(df, original_units=True), ["vec_id"], "reconstruction",
                 "pos", "v")


def _score_oracle(semantics: str, method: str) -> str:
    sql, layer = _layer("embeddings", 8, method, semantics)
    return sql.render(f"SELECT id AS vec_id, {o.rounded('loss')} AS loss FROM {layer.losses}")


@register("score", _score_oracle("standard", "regular"))
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8], method="regular", **EMBEDDING)
    return model.score(df).select("vec_id", r6("loss").alias("loss"))


@register("score_reference", _score_oracle("reference", "denoising"))
def score_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8], method="denoising", semantics="reference", **EMBEDDING)
    return model.score(df).select("vec_id", r6("loss").alias("loss"))


def _score_far_oracle() -> str:
    sql, n = o.source("embeddings")
    (w, s), = start_tables(sql, [n, 8])
    # Twice the trained values, cut off at the trained range; vectors with a null element are left out.
    sql.add(
        "far",
        "SELECT id, i, CASE WHEN hi > lo THEN least(1e0, greatest(0e0, (2 * v - lo) / (hi - lo))) "
        "ELSE 0e0 END AS v FROM raw JOIN rng USING (i) WHERE id % 7 <> 0",
    )
    layer = o.Layer(sql, "q", "far", n, w, s, "regular", "standard", None, False, 0.05, BETA, "sigmoid")
    return sql.render(
        f"SELECT vec_id, {o.rounded('loss')} AS loss FROM embeddings "
        f"LEFT JOIN {layer.losses} l ON l.id = vec_id"
    )


@register("score_out_of_range", _score_far_oracle())
def score_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8], method="regular", outside="clip", **EMBEDDING)
    far = df.withColumn("embedding", F.transform("embedding", lambda v, i: F.when(
        (F.col("vec_id") % 7 != 0) | (i != 0), v.cast("double") * 2)))
    return model.score(far).select("vec_id", r6("loss").alias("loss"))


def _score_columns_oracle() -> str:
    sql, layer = _layer("lineitem", 3, "regular")
    return sql.render(
        f"SELECT l_orderkey, l_linenumber, {o.rounded('loss')} AS loss "
        f"FROM {layer.losses} JOIN li USING (id)"
    )


@register("score_columns", _score_columns_oracle())
def score_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    model = start_model(df, [3], method="regular", **LINE)
    return model.score(df).select("l_orderkey", "l_linenumber", r6("loss").alias("loss"))


def _residual_oracle() -> str:
    sql, layer = _layer("lineitem", 3, "regular")
    return sql.render(
        f"SELECT l_orderkey, l_linenumber, {o.rounded('a')} AS square_error, "
        f"{o.rounded('b')} AS loss FROM (SELECT id, sum(e * e) AS a FROM {layer.e} GROUP BY id) "
        f"JOIN (SELECT id, loss AS b FROM {layer.losses}) USING (id) JOIN li USING (id)"
    )


@register("column_expressions", _residual_oracle())
def column_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode, residual and loss as column expressions only, without Python tasks."""
    df = op.scale_minmax(lineitem(spark, sf_dir), o.LINE_COLUMNS)
    w = initial_encoder(4, 3, STANDARD, 0, 1)
    h = fn.over_array(fn.sigmoid, fn.vector_times_matrix(fn.with_bias("scaled"), w))
    p = fn.over_array(
        fn.sigmoid, fn.vector_times_matrix(fn.with_bias("h"), initial_decoder(w))
    )
    e = fn.residual("p", "scaled")
    return (
        df.withColumn("h", h).withColumn("p", p).withColumn("e", e)
        .select("l_orderkey", "l_linenumber", r6(fn.dot("e", "e")).alias("square_error"),
                r6(fn.cross_entropy("scaled", "p")).alias("loss"))
    )


# --- aggregations ----------------------------------------------------------------------------


def _activity_oracle(table: str, k: int) -> str:
    sql, layer = _layer(table, k, "sparse")
    return sql.render(
        f"SELECT CAST(j AS INTEGER) AS unit, {o.rounded('p')} AS p, "
        f"(SELECT m FROM {layer.j}) AS m FROM {layer.pj}"
    )


@register("mean_activation", _activity_oracle("embeddings", 8))
def mean_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8], method="sparse", **EMBEDDING)
    return model.mean_activation(df).withColumn("p", r6("p"))


@register("mean_activation_columns", _activity_oracle("lineitem", 3))
def mean_activation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    model = start_model(df, [3], method="sparse", **LINE)
    return model.mean_activation(df).withColumn("p", r6("p"))


def _kl_oracle() -> str:
    sql, layer = _layer("lineitem", 3, "sparse")
    return sql.render(
        f"SELECT CAST(j AS INTEGER) AS unit, {o.rounded('p')} AS p, {o.rounded('kl')} AS kl, "
        f"{o.rounded(f'{o.number(BETA)} * pull')} AS kl_gradient FROM {layer.kl}"
    )


@register("kl_terms", _kl_oracle())
def kl_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lineitem(spark, sf_dir)
    model = start_model(df, [3], method="sparse", beta=BETA, **LINE)
    return model.sparsity_terms(df).select(
        "unit", *[r6(c).alias(c) for c in ("p", "kl", "kl_gradient")]
    )


def _kl_sum_oracle() -> str:
    sql, layer = _layer("embeddings", 8, "sparse")
    return sql.render(f"SELECT {o.rounded('sum(kl)')} AS kl, count(*) AS units FROM {layer.kl}")


@register("kl_sum", _kl_sum_oracle())
def kl_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8], method="sparse", beta=BETA, **EMBEDDING)
    return model.sparsity_terms(df).agg(
        r6(F.sum("kl")).alias("kl"), F.count(F.lit(1)).alias("units")
    )


def _gradient_oracle(table: str, k: int, method: str, semantics: str, tied: bool,
                     activation: str = "sigmoid") -> str:
    sql, layer = _layer(table, k, method, semantics, tied, activation=activation)
    return _gradient_select(sql, layer, tied)


def _gradient_select(sql: o.Sql, layer: o.Layer, tied: bool) -> str:
    parts = [("encoder", layer.gw)] + ([] if tied else [("decoder", layer.gs)])
    return sql.render(" UNION ALL ".join(
        f"SELECT '{role}' AS role, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "
        f"{o.rounded('g')} AS g, (SELECT m FROM {layer.j}) AS m FROM {t}"
        for role, t in parts
    ))


def _register_gradient(method: str, semantics: str, tied: bool = False) -> None:
    name = f"gradients_{'tied_' if tied else ''}{method}"
    name += "" if semantics == "standard" else "_reference"

    @register(name, _gradient_oracle("embeddings", 8, method, semantics, tied))
    def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = embeddings(spark, sf_dir)
        model = start_model(
            df, [8], method=method, semantics=semantics, beta=BETA,
            decoder="tied" if tied else "separate", **EMBEDDING,
        )
        return model.gradients(df).withColumn("g", r6("g"))


for _semantics in ("standard", "reference"):
    for _method in ("regular", "denoising", "sparse"):
        _register_gradient(_method, _semantics)
_register_gradient("regular", "standard", tied=True)
_register_gradient("denoising", "reference", tied=True)
_register_gradient("sparse", "standard", tied=True)


def _register_gradient_activation(activation: str) -> None:
    @register(f"gradients_{activation}",
              _gradient_oracle("embeddings", 6, "regular", "standard", False, activation))
    def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = embeddings(spark, sf_dir)
        model = start_model(df, [6], method="regular", activation=activation, **EMBEDDING)
        return model.gradients(df).withColumn("g", r6("g"))


for _name in ("tanh", "relu", "lrelu", "elu"):
    _register_gradient_activation(_name)


def _gradient_layer2_oracle() -> str:
    sql, n = o.source("embeddings")
    (w1, _), (w2, s2) = start_tables(sql, [n, 8, 4])
    codes = o.forward(sql, "c1", "x1", w1)
    layer = o.Layer(sql, "q", codes, 8, w2, s2, "sparse", "standard", None, False, 0.05, BETA)
    return _gradient_select(sql, layer, False)


@register("gradients_layer2", _gradient_layer2_oracle())
def gradients_layer2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient sums of the second layer, on the codes of the first."""
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8, 4], method="sparse", beta=BETA, **EMBEDDING)
    return model.gradients(df, layer=2).withColumn("g", r6("g"))


def _register_gradient_columns(method: str) -> None:
    @register(f"gradients_columns_{method}",
              _gradient_oracle("lineitem", 3, method, "standard", False))
    def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lineitem(spark, sf_dir)
        model = start_model(df, [3], method=method, beta=BETA, **LINE)
        return model.gradients(df).withColumn("g", r6("g"))


for _method in ("regular", "sparse"):
    _register_gradient_columns(_method)


# --- training --------------------------------------------------------------------------------


def _fit(df: DataFrame, method: str, semantics: str, epochs: int, hidden: list[int],
         source: dict, tied: bool = False) -> StackedAutoencoderModel:
    return StackedAutoencoder(
        hidden=hidden, method=method, semantics=semantics, epochs=epochs, beta=BETA,
        lmbda=1e-3, decoder="tied" if tied else "separate", **source,
    ).fit(df)


def _trained(table: str, hidden: list[int], method: str, semantics: str, epochs: int,
             tied: bool = False, start=initial_encoder):
    sql, n = o.source(table)
    losses, finals, codes = o.training(
        sql, n, hidden, method, semantics, epochs, lmbda=1e-3, beta=BETA, tied=tied, start=start
    )
    return sql, losses, finals, codes


def _history_oracle(*args, **options) -> str:
    sql, losses, _, _ = _trained(*args, **options)
    return sql.render(o.history_select(losses))


def _weights_oracle(*args, **options) -> str:
    sql, _, finals, _ = _trained(*args, **options)
    return sql.render(o.weights_select(finals))


def _register_training(method: str, semantics: str) -> None:
    suffix = method + ("" if semantics == "standard" else "_reference")
    hidden = [8, 4]

    @register(f"train_history_{suffix}",
              _history_oracle("embeddings", hidden, method, semantics, 3))
    def history(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _fit(embeddings(spark, sf_dir), method, semantics, 3, hidden, EMBEDDING)
        return model.history.withColumn("loss", r6("loss"))

    @register(f"update_step_{suffix}", _weights_oracle("embeddings", [8], method, semantics, 1))
    def update_step(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _fit(embeddings(spark, sf_dir), method, semantics, 1, [8], EMBEDDING)
        return _weights(model)


def _weights(model: StackedAutoencoderModel) -> DataFrame:
    return op.flatten_weights(model.weights_df()).select(
        "layer", "role", "row", "col", r6("w").alias("w")
    )


for _semantics in ("standard", "reference"):
    for _method in ("regular", "denoising", "sparse"):
        _register_training(_method, _semantics)


def _register_training_columns(method: str) -> None:
    @register(f"train_history_columns_{method}",
              _history_oracle("lineitem", [3, 2], method, "standard", 3))
    def history(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = _fit(lineitem(spark, sf_dir), method, "standard", 3, [3, 2], LINE)
        return model.history.withColumn("loss", r6("loss"))


for _method in ("regular", "sparse"):
    _register_training_columns(_method)


@register("train_history_tied",
          _history_oracle("embeddings", [8, 4], "regular", "standard", 3, tied=True))
def train_history_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fit(embeddings(spark, sf_dir), "regular", "standard", 3, [8, 4], EMBEDDING, True)
    return model.history.withColumn("loss", r6("loss"))


@register("weights_long", _weights_oracle("embeddings", [8, 4], "regular", "standard", 2))
def weights_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(_fit(embeddings(spark, sf_dir), "regular", "standard", 2, [8, 4], EMBEDDING))


def _transpose_oracle() -> str:
    sql, _, finals, _ = _trained("lineitem", [3, 2], "regular", "standard", 2)
    return sql.render(
        f"SELECT layer, role, col AS row, row AS col, w FROM ({o.weights_select(finals)})"
    )


@register("weights_transposed", _transpose_oracle())
def weights_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fit(lineitem(spark, sf_dir), "regular", "standard", 2, [3, 2], LINE)
    again = op.assemble_weights(op.flatten_weights(model.weights_df()))
    long = op.transpose_weights(op.flatten_weights(again))
    return long.withColumn("w", r6("w"))


def _norm_oracle() -> str:
    sql, _, finals, _ = _trained("lineitem", [3, 2], "regular", "standard", 2)
    return sql.render(
        "SELECT layer, role, "
        f"{o.rounded('sum(CASE WHEN row > 0 THEN w * w ELSE 0e0 END)')} AS square_sum, "
        f"{o.rounded('sqrt(sum(w * w))')} AS norm FROM ({o.weights_select(finals, 15)}) GROUP BY 1, 2"
    )


@register("weight_norms", _norm_oracle())
def weight_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fit(lineitem(spark, sf_dir), "regular", "standard", 2, [3, 2], LINE)
    return op.weight_norms(op.flatten_weights(model.weights_df())).select(
        "layer", "role", r6("square_sum").alias("square_sum"), r6("norm").alias("norm")
    )


def _encode_trained_oracle(table: str, hidden: list[int], method: str, semantics: str) -> str:
    sql, _, _, codes = _trained(table, hidden, method, semantics, 2)
    return sql.render(
        f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS unit, {o.rounded('v')} AS a FROM {codes}"
    )


@register("model_roundtrip",
          _encode_trained_oracle("embeddings", [8, 4], "denoising", "standard"))
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, save, load and encode."""
    df = embeddings(spark, sf_dir)
    path = scratch(spark, "model")
    _fit(df, "denoising", "standard", 2, [8, 4], EMBEDDING).write().save(path)
    model = StackedAutoencoderModel.load(path)
    return _long(model.encode(df), ["vec_id"], "code", "unit", "a")


@register("stream_encode", _encode_oracle("embeddings", [8, 4], 2))
def stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a file stream, written to a table."""
    df = embeddings(spark, sf_dir)
    model = start_model(df, [8, 4], method="regular", **EMBEDDING)
    stream = table_stream(spark, sf_dir, "embeddings", df.schema)
    path, checkpoint = scratch(spark, "stream"), scratch(spark, "progress")
    query = score_stream(model, stream, path, checkpoint, ["vec_id"], available_now=True)
    query.awaitTermination()
    return _long(spark.read.parquet(path), ["vec_id"], "code", "unit", "a")


# --- files -----------------------------------------------------------------------------------


@register("libsvm_roundtrip", _scaled_oracle("lineitem"))
def libsvm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled columns through LibSVM text; the label carries the line number."""
    df = op.scale_minmax(lineitem(spark, sf_dir), o.LINE_COLUMNS)
    packed = df.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("label"), "scaled"
    )
    path = scratch(spark, "libsvm")
    write_libsvm(packed, path, "label", "scaled")
    again = read_features(spark, path, "libsvm", num_features=4)
    label = F.col("label").cast("bigint")
    return again.select(
        F.floor(label / 10).alias("l_orderkey"), (label % 10).cast("int").alias("l_linenumber"),
        F.posexplode("features").alias("pos", "v"),
    ).withColumn("v", r6("v"))


def _text_oracle() -> str:
    sql, _, finals, _ = _trained("lineitem", [3, 2], "regular", "standard", 2)
    return sql.render(
        "SELECT layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY row, col) - 1 AS INTEGER) "
        f"AS pos, w FROM ({o.weights_select(finals)}) WHERE role = 'encoder'"
    )


@register("weights_text", _text_oracle())
def weights_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained weights through the text layout and back."""
    model = _fit(lineitem(spark, sf_dir), "regular", "standard", 2, [3, 2], LINE)
    path = model.export_text(scratch(spark, "text"), "line")
    again = op.model_table(spark, import_text(spark, path), [])
    return text_lines(again, [4, 3, 2]).where("layer > 0").select(
        "layer", F.col("pos").cast("int").alias("pos"),
        r6(F.col("value").cast("double")).alias("w"),
    )


# --- sparse vectors --------------------------------------------------------------------------


SPARSE = {"featuresCol": "features", "idCols": ["vec_id"]}


def sparse_vectors(spark: SparkSession, sf_dir: str, both_signs: bool) -> DataFrame:
    """Embeddings without their small values, as sparse ML vectors read from LibSVM text."""
    kept = lambda v: F.abs(v) > o.SMALL if both_signs else v > o.SMALL
    thin = embeddings(spark, sf_dir).select(
        "vec_id",
        F.transform("embedding", lambda v: F.when(kept(v.cast("double")), v.cast("double")).otherwise(0.0))
        .alias("thin"),
    )
    path = scratch(spark, "sparse")
    write_libsvm(thin, path, "vec_id", "thin")
    again = read_features(spark, path, "libsvm", num_features=64, sparse=True)
    return again.select(F.col("label").cast("bigint").alias("vec_id"), "features")


def _register_sparse_vectors(method: str, both_signs: bool) -> None:
    table = "thin_signed" if both_signs else "thin"
    suffix = method + ("_signed" if both_signs else "")

    @register(f"train_history_vectors_{suffix}",
              _history_oracle(table, [8, 4], method, "standard", 3))
    def history(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Training on sparse vectors, whose blocks and products stay sparse."""
        df = sparse_vectors(spark, sf_dir, both_signs)
        model = _fit(df, method, "standard", 3, [8, 4], SPARSE)
        return model.history.withColumn("loss", r6("loss"))

    @register(f"gradients_vectors_{suffix}",
              _gradient_oracle(table, 8, method, "standard", False))
    def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sparse_vectors(spark, sf_dir, both_signs)
        model = start_model(df, [8], method=method, beta=BETA, **SPARSE)
        return model.gradients(df).withColumn("g", r6("g"))


for _method in ("regular", "denoising", "sparse"):
    _register_sparse_vectors(_method, False)
_register_sparse_vectors("regular", True)
_register_sparse_vectors("sparse", True)


@register("encode_vectors", _encode_oracle("thin_signed", [8, 4], 2))
def encode_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sparse_vectors(spark, sf_dir, True)
    model = start_model(df, [8, 4], method="regular", **SPARSE)
    return _long(model.encode(df), ["vec_id"], "code", "unit", "a")


def _score_vectors_oracle() -> str:
    sql, layer = _layer("thin_signed", 8, "regular")
    return sql.render(f"SELECT id AS vec_id, {o.rounded('loss')} AS loss FROM {layer.losses}")


@register("score_vectors", _score_vectors_oracle())
def score_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sparse_vectors(spark, sf_dir, True)
    model = start_model(df, [8], method="regular", **SPARSE)
    return model.score(df).select("vec_id", r6("loss").alias("loss"))


# --- layers in slices --------------------------------------------------------------------------


def _unit_starts(n: int, k: int, rules: Rules, seed: int, layer: int):
    return initial_units(n, 0, k, seed, layer)


def _fit_blocked(df: DataFrame, method: str, hidden: list[int], epochs: int, tied: bool = False,
                 features: str = "embedding"):
    """Slices of two units; a task holds less than a layer."""
    return fit_blocked(
        df, slice_bytes=2200, features=features, ids=["vec_id"], hidden=hidden, method=method,
        epochs=epochs, beta=BETA, lmbda=1e-3, tied=tied, model_bytes=4000,
    )


def _register_blocked(method: str, tied: bool = False) -> None:
    suffix = method + ("_tied" if tied else "")

    @register(f"train_history_blocked_{suffix}",
              _history_oracle("embeddings", [8, 4], method, "standard", 2, tied=tied,
                              start=_unit_starts))
    def history(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Training of a stack whose layers are larger than a task may hold."""
        stack = _fit_blocked(embeddings(spark, sf_dir), method, [8, 4], 2, tied)
        return stack.history.withColumn("loss", r6("loss"))


for _method in ("regular", "denoising", "sparse"):
    _register_blocked(_method)
_register_blocked("regular", True)


@register("update_step_blocked",
          _weights_oracle("embeddings", [8, 4], "sparse", "standard", 2, start=_unit_starts))
def update_step_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = _fit_blocked(embeddings(spark, sf_dir), "sparse", [8, 4], 2)
    return stack.weights_long().withColumn("w", r6("w"))


def _encode_blocked_oracle() -> str:
    sql, _, _, codes = _trained("thin_signed", [8, 4], "regular", "standard", 2, start=_unit_starts)
    return sql.render(
        f"SELECT id AS vec_id, CAST(i - 1 AS INTEGER) AS unit, {o.rounded('v')} AS a FROM {codes}"
    )


@register("encode_blocked", _encode_blocked_oracle())
def encode_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of sparse vectors by a trained stack in slices."""
    df = sparse_vectors(spark, sf_dir, True)
    stack = _fit_blocked(df, "regular", [8, 4], 2, features="features")
    return _long(stack.encode(df, ["vec_id"]), ["vec_id"], "code", "unit", "a")


# --- gradient check --------------------------------------------------------------------------


def _check_oracle(method: str, eps: float = 1e-3, lmbda: float = 1e-3, k: int = 2,
                  summary: bool = False) -> str:
    """Brute force: the whole mean loss for every weight moved up and down."""
    n = 4
    w = initial_encoder(n, k, STANDARD, 0, 1)
    s = initial_decoder(w)
    cells = [("w", i, j) for i in range(n + 1) for j in range(k)]
    cells += [("s", i, j) for i in range(k + 1) for j in range(n)]
    base = {("w", i, j): w[i, j] for i in range(n + 1) for j in range(k)}
    base |= {("s", i, j): s[i, j] for i in range(k + 1) for j in range(n)}
    rows = []
    for at, cell in enumerate(cells):
        for sign in (1, -1):
            moved = [base[c] + (sign * eps if c == cell else 0.0) for c in cells]
            rows.append(f"({at}, {sign}, " + ", ".join(o.number(v) for v in moved) + ")")
    names = [f"{m}{i}_{j}" for m, i, j in cells]
    sql, _ = o.source("lineitem")
    sql.add("wide", "SELECT id, " + ", ".join(
        f"max(CASE WHEN i = {i} THEN v END) AS x{i}" for i in range(1, n + 1)
    ) + " FROM x1 GROUP BY id")
    sql.add("q", f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(cell, side, {', '.join(names)})")
    hidden = ", ".join(
        o.sigmoid(f"w0_{j} + " + " + ".join(f"w{i}_{j} * x{i}" for i in range(1, n + 1)))
        + f" AS h{j + 1}" for j in range(k)
    )
    outputs = ", ".join(
        o.sigmoid(f"s0_{g} + " + " + ".join(f"s{i}_{g} * h{i}" for i in range(1, k + 1)))
        + f" AS p{g + 1}" for g in range(n)
    )
    loss = " + ".join(f"-(x{g} * ln(p{g}) + (1e0 - x{g}) * ln(1e0 - p{g}))" for g in range(1, n + 1))
    l2 = " + ".join(f"{m}{i}_{j} * {m}{i}_{j}" for m, i, j in cells if i > 0)
    means = ", ".join(f"avg(h{j}) AS m{j}" for j in range(1, k + 1))
    kl = " + ".join(
        f"(0.05e0 * ln(0.05e0 / m{j}) + 0.95e0 * ln(0.95e0 / (1e0 - m{j})))" for j in range(1, k + 1)
    )
    weight = o.number(BETA) if method == "sparse" else "0e0"
    cost = f"l + {weight} * ({kl}) + {o.number(lmbda / 2)} * r"
    sql.add("cost", f"SELECT cell, side, {cost} AS c FROM (SELECT cell, side, avg({loss}) AS l, "
                    f"any_value({l2}) AS r, {means} FROM (SELECT *, {outputs} FROM "
                    f"(SELECT *, {hidden} FROM wide, q)) GROUP BY cell, side)")
    labels = ", ".join(
        f"({at}, '{'encoder' if m == 'w' else 'decoder'}', {i}, {j})"
        for at, (m, i, j) in enumerate(cells)
    )
    source = f"FROM cost JOIN (VALUES {labels}) AS n(cell, role, i, j) USING (cell)"
    if summary:
        return sql.render(
            f"SELECT role, {o.rounded(f'sum(side * c) / {o.number(2 * eps)}')} AS numeric, "
            f"true AS agree {source} GROUP BY role"
        )
    return sql.render(
        "SELECT role, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "
        f"{o.rounded(f'sum(side * c) / {o.number(2 * eps)}')} AS numeric, true AS agree "
        f"{source} GROUP BY role, i, j"
    )


def _register_check(method: str) -> None:
    @register(f"check_gradients_{method}", _check_oracle(method))
    def check(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lineitem(spark, sf_dir)
        model = start_model(df, [2], method=method, beta=BETA, lmbda=1e-3, **LINE)
        return model.check_gradients(df).select(
            "role", "i", "j", r6("numeric").alias("numeric"),
            (F.col("difference") < 1e-6).alias("agree"),
        )


for _method in ("regular", "sparse"):
    _register_check(_method)


@register("check_gradients_summary", _check_oracle("regular", summary=True))
def check_gradients_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = check_gradients(
        lineitem(spark, sf_dir), hidden=[2], method="regular", lmbda=1e-3, **LINE
    )
    return summarize_check(check).select(
        "role", r6("numeric").alias("numeric"), (F.abs("difference") < 1e-5).alias("agree")
    )


_DIRECTIONS, _DIRECTION_EPS = 2, 1e-3


def _direction_oracle(method: str) -> str:
    """The whole cost at both ends of each direction, and the gradient's product with it."""
    k, lmbda = 3, 1e-3
    w = initial_encoder(64, k, STANDARD, 0, 1)
    s = initial_decoder(w)
    sql, n = o.source("embeddings")
    mask = o.hashed_mask(sql, "hm", n, 1, 0, 0, 0.5) if method == "denoising" else None

    def layer(tag: str, w, s) -> o.Layer:
        names = sql.add(f"{tag}_w0", o.matrix_values(w)), sql.add(f"{tag}_s0", o.matrix_values(s))
        return o.Layer(sql, tag, "x1", n, *names, method, "standard", mask, beta=BETA)

    base = layer("b", w, s)
    parts = []
    for d in range(_DIRECTIONS):
        by_w, by_s = direction((n, k), d, 0, False)
        sql.add(f"r{d}_w", o.matrix_values(by_w))
        sql.add(f"r{d}_s", o.matrix_values(by_s))
        ends = [(w + e * by_w, s + e * by_s) for e in (_DIRECTION_EPS, -_DIRECTION_EPS)]
        costs = [layer(f"p{d}_{i}", *end).j for i, end in enumerate(ends)]
        l2 = [lmbda / 2 * ((a[1:] ** 2).sum() + (b[1:] ** 2).sum()) for a, b in ends]
        slope = lmbda * ((w[1:] * by_w[1:]).sum() + (s[1:] * by_s[1:]).sum())
        along = " + ".join(
            f"(SELECT sum(g.g * r.w) FROM {g} g JOIN r{d}_{m} r USING (i, j))"
            for g, m in ((base.gw, "w"), (base.gs, "s"))
        )
        parts.append(
            f"SELECT {d} AS direction, ({along}) / (SELECT m FROM {base.j}) + {o.number(slope)} AS a, "
            f"((SELECT loss FROM {costs[0]}) - (SELECT loss FROM {costs[1]}) + {o.number(l2[0] - l2[1])}) "
            f"/ {o.number(2 * _DIRECTION_EPS)} AS b"
        )
    return sql.render(
        f"SELECT direction, {o.rounded('a')} AS analytic, {o.rounded('b')} AS numeric "
        f"FROM ({' UNION ALL '.join(parts)})"
    )


def _register_directions(method: str) -> None:
    @register(f"check_directions_{method}", _direction_oracle(method))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Slopes of the cost along random directions, on the whole table."""
        df = embeddings(spark, sf_dir)
        model = start_model(df, [3], method=method, beta=BETA, lmbda=1e-3, **EMBEDDING)
        found = model.check_directions(df, eps=_DIRECTION_EPS, directions=_DIRECTIONS)
        return found.select("direction", r6("analytic").alias("analytic"), r6("numeric").alias("numeric"))


for _method in ("regular", "denoising", "sparse"):
    _register_directions(_method)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, train one layer for three epochs and encode."""
    ship(spark)
    df = embeddings(spark, sf_dir)
    model = StackedAutoencoder(hidden=[8], epochs=3, method="regular", **EMBEDDING).fit(df)
    return model.encode(df).select("vec_id", "code")

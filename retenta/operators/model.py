"""Churn model: feature alignment, scorers, training and the batch report
(M1, M2, M3, F7, A10, A11, L1, X16, X17, X19, X20).

A scorer is a function ``DataFrame -> DataFrame`` that adds a ``proba`` column
(probability of churn, 0-1). Two are provided:

* :func:`rule_scorer` - the weighted churn score divided by 100; pure Column
  arithmetic, deterministic, so reports built on it can be checked in SQL;
* :func:`ml_scorer` - a Spark ML ``PipelineModel`` trained by
  :func:`train_churn_model` (FeatureHasher → VectorAssembler → GBTClassifier);
  scoring runs ``transform`` on the executors, partition by partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..session import materialize

# The model's feature list with declared types, in model order.
FEATURES = [
    ("edad", "int64"),
    ("sexo", "string"),
    ("estado", "string"),
    ("ciudad", "string"),
    ("nivel_educativo", "string"),
    ("ocupacion", "string"),
    ("ingreso_mensual_mxn", "int64"),
    ("antiguedad_dias", "int64"),
    ("es_hey_pro", "bool"),
    ("canal_apertura", "string"),
    ("dias_desde_ultimo_login", "int64"),
    ("preferencia_canal", "string"),
    ("satisfaccion_1_10", "float64"),
    ("num_productos_activos", "int64"),
    ("input", "string"),
    ("credito_auto", "bool"),
    ("credito_nomina", "bool"),
    ("credito_personal", "bool"),
    ("cuenta_debito", "bool"),
    ("cuenta_negocios", "bool"),
    ("inversion_hey", "bool"),
    ("seguro_compras", "bool"),
    ("seguro_vida", "bool"),
    ("tarjeta_credito_garantizada", "bool"),
    ("tarjeta_credito_hey", "bool"),
    ("tarjeta_credito_negocios", "bool"),
    ("saldo_promedio", "float64"),
    ("dispositivo_moda", "string"),
    ("canal_moda", "string"),
    ("categoria_mcc_moda", "string"),
    ("abono_inversion", "bool"),
    ("cargo_recurrente", "bool"),
    ("cashback", "bool"),
    ("compra", "bool"),
    ("deposito_farmacia", "bool"),
    ("deposito_oxxo", "bool"),
    ("pago_credito", "bool"),
    ("pago_servicio", "bool"),
    ("retiro_cajero", "bool"),
    ("retiro_inversion", "bool"),
    ("transf_entrada", "bool"),
    ("transf_salida", "bool"),
    ("monto_promedio", "float64"),
    ("monto_min", "float64"),
    ("monto_max", "float64"),
]
_NAMES = [name for name, _ in FEATURES]
#: the features that say whether a client holds a product, or has used an operation
PRODUCT_FLAGS = _NAMES[_NAMES.index("credito_auto") : _NAMES.index("saldo_promedio")]
OPERATION_FLAGS = _NAMES[_NAMES.index("abono_inversion") : _NAMES.index("monto_promedio")]
# Imputation for a feature missing from the input, and report defaults.
MISSING_CATEGORY = "SIN REGISTRO"
UNKNOWN_CITY = "Desconocida"
HASH_WIDTH = 256            # 0/1 features that the categories are hashed to
HELD_OUT_SIXTEENTHS = 4     # sixteenths of the clients that the model is measured on
FALLBACK_ID_PREFIX = "N-"
SPARK_TYPES = {"int64": T.LongType(), "float64": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType()}

Scorer = Callable[[DataFrame], DataFrame]


def align_features(
    df: DataFrame, features: Sequence[tuple[str, str]] = FEATURES, keep: Sequence[str] = ()
) -> DataFrame:
    """Input columns aligned to the feature list.

    Present categoricals are cast to text, other present features keep their values
    and types (:func:`model_inputs` makes numbers of them); a missing categorical
    becomes ``SIN REGISTRO`` and any other missing feature 0 (false for booleans). Output: ``keep`` columns, then the features in list order.
    """
    have = set(df.columns)
    cols = [F.col(k) for k in keep if k in have]
    for name, kind in features:
        target = SPARK_TYPES[kind]
        if name in have:
            cols.append(F.col(name).cast("string").alias(name) if kind == "string" else F.col(name))
        elif kind == "string":
            cols.append(F.lit(MISSING_CATEGORY).alias(name))
        else:
            cols.append(F.lit(0).cast(target).alias(name))
    return df.select(*cols)


def rule_scorer(df: DataFrame) -> DataFrame:
    """proba = weighted churn score / 100 (X1) over the input's columns.

    Missing login or product counts read as 0 here (the input is an aligned
    upload), as do those that are no numbers; a missing days-without-transactions
    column reads as 90.
    """
    number = lambda c: F.col(c).try_cast("double")
    whole = lambda c: number(c).try_cast("long")
    days_tx = whole("dias_sin_tx") if "dias_sin_tx" in df.columns else F.lit(None).cast("long")
    score = X.churn_score(
        F.coalesce(whole("dias_desde_ultimo_login"), F.lit(0).cast("long")),
        number("satisfaccion_1_10"),
        F.coalesce(whole("num_productos_activos"), F.lit(0).cast("long")),
        days_tx,
    )
    return df.withColumn("proba", score / F.lit(100.0))


def build_pipeline(
    categorical_cols: Sequence[str],
    numeric_cols: Sequence[str],
    label_col: str = "label",
    max_iter: int = 20,
    seed: int = 42,
    hash_width: int = HASH_WIDTH,
) -> Pipeline:
    """FeatureHasher over the categoricals → VectorAssembler → GBTClassifier.

    Each (column, category) is hashed to one of ``hash_width`` 0/1 features, so no
    dictionary of categories is collected, the model's size does not grow with them,
    and a category unseen in training needs no rule.
    """
    hashed = "__categories"
    hashers = (
        [FeatureHasher(inputCols=list(categorical_cols), outputCol=hashed, numFeatures=hash_width)]
        if categorical_cols
        else []
    )
    assembler = VectorAssembler(
        inputCols=[hashed] * bool(categorical_cols) + list(numeric_cols),
        outputCol="features",
        handleInvalid="keep",
    )
    gbt = GBTClassifier(labelCol=label_col, featuresCol="features", maxIter=max_iter, seed=seed)
    return Pipeline(stages=[*hashers, assembler, gbt])


def model_inputs(df: DataFrame, features: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str], list[str]]:
    """Model view of the features: string features are categorical (text, null as
    ``SIN REGISTRO``); booleans and numbers become doubles, with null and what is no
    number as 0."""
    cats = [n for n, t in features if t == "string"]
    nums = [n for n, t in features if t != "string"]
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY)).alias(c) for c in cats]
    cols += [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in nums]
    others = [F.col(c) for c in df.columns if c not in set(cats) | set(nums)]
    return df.select(*others, *cols), cats, nums


def table_features(df: DataFrame, exclude: Sequence[str]) -> list[tuple[str, str]]:
    """Feature list from a table's schema.

    Text → string, boolean → bool, whole numbers → int64, other numbers → float64.
    """
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        t = f.dataType
        if isinstance(t, T.StringType):
            out.append((f.name, "string"))
        elif isinstance(t, T.BooleanType):
            out.append((f.name, "bool"))
        elif isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            out.append((f.name, "int64"))
        elif isinstance(t, T.NumericType):
            out.append((f.name, "float64"))
    return out


def numeric_features(features: Sequence[tuple[str, str]] = FEATURES) -> list[tuple[str, str]]:
    """The features that are numbers or flags: what a model compiled to expressions uses."""
    return [(name, kind) for name, kind in features if kind != "string"]


def held_out(id_col: str = "user_id", sixteenths: int = HELD_OUT_SIXTEENTHS) -> Column:
    """Whether a client is kept from training: by the first hex digit of its id's md5,
    the same on every run."""
    first = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 1), 16, 10).cast("int")
    return first < sixteenths


def train_churn_model(
    table: DataFrame,
    features: Sequence[tuple[str, str]],
    label_col: str = "UsuarioChurn",
    max_iter: int = 20,
    seed: int = 42,
) -> tuple[PipelineModel, list[tuple[str, str]]]:
    """Fit the churn pipeline on a labelled feature table.

    The label is the churn flag of ``label_col`` (trim + upper = CHURN). The training
    input is persisted (memory and disk) for the fit, which reads it once per boosting
    round; a lost executor's blocks are rebuilt from the lineage.
    """
    inputs, cats, nums = model_inputs(table.withColumn("label", X.is_churn(label_col).cast("double")), features)
    inputs = inputs.persist()
    try:
        model = build_pipeline(cats, nums, "label", max_iter=max_iter, seed=seed).fit(inputs)
    finally:
        inputs.unpersist()
    return model, list(features)


def ml_scorer(model: PipelineModel, features: Sequence[tuple[str, str]]) -> Scorer:
    """Scorer running a fitted pipeline; ``proba`` is P(class 1) (M2)."""

    def score(df: DataFrame) -> DataFrame:
        inputs, _, _ = model_inputs(df, features)
        scored = model.transform(inputs)
        keep = [c for c in df.columns]
        return scored.select(*keep, vector_to_array(F.col("probability"))[1].alias("proba"))

    return score


def evaluate_auc(
    model: PipelineModel, table: DataFrame, features: Sequence[tuple[str, str]], label_col: str = "UsuarioChurn"
) -> float:
    """Area under ROC of the model on ``table``."""
    inputs, _, _ = model_inputs(table.withColumn("label", X.is_churn(label_col).cast("double")), features)
    pred = model.transform(inputs)
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction").evaluate(pred)


#: blocks whose offsets are broadcast; more are joined
BROADCAST_BLOCKS = 100_000


def with_row_index(df: DataFrame, out_col: str = "_row") -> DataFrame:
    """0-based contiguous row numbers in input order.

    Rows that are read from files are numbered in the order of the files' paths and of the
    places in them, however Spark splits or packs the files: a row's number is the rows of
    all blocks before its own plus its position in the block. Other frames are numbered in
    the order of their partitions. Blocks are counted in one aggregate; the running sum over
    them runs in range partitions, of which only the sums (one a partition) reach the driver.
    """
    try:
        at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    except AnalysisException:
        at = df.select("*", F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_start"))
    tagged = at.withColumn("_mid", F.monotonically_increasing_id())
    blocks = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    ranged = materialize(blocks.repartitionByRange("_file", "_start").withColumn("_part", F.spark_partition_id()), "checkpoint")
    before, total, n_blocks = {}, 0, 0
    for r in ranged.groupBy("_part").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("blocks")).orderBy("_part").collect():
        before[r["_part"]], total, n_blocks = total, total + r["rows"], n_blocks + r["blocks"]
    w = Window.partitionBy("_part").orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    offset = starts[F.col("_part").cast("long")] + F.coalesce(F.sum("_n").over(w), F.lit(0))
    offsets = ranged.select("_file", "_start", "_first", offset.alias("_off"))
    offsets = F.broadcast(offsets) if n_blocks <= BROADCAST_BLOCKS else offsets
    numbered = tagged.join(offsets, ["_file", "_start"])
    return numbered.withColumn(out_col, F.col("_off") + F.col("_mid") - F.col("_first")).drop("_file", "_start", "_mid", "_first", "_off")


# The report's columns, in output order.
REPORT_COLUMNS = [
    "user_id", "edad", "num_productos_activos", "satisfaccion_1_10", "ingreso_mensual_mxn", "prob_churn", "ciudad",
]


def scored_upload(upload: DataFrame, scorer: Scorer, features: Sequence[tuple[str, str]] = FEATURES) -> DataFrame:
    """The 7-column scoring frame of an upload.

    Features are aligned first (so a missing ``ciudad`` is ``SIN REGISTRO``, D11),
    then scored; ``prob_churn`` is the probability as a truncated whole percent.
    A missing id becomes ``N-<row>``, other missing report columns 0 or
    ``Desconocida``.
    """
    keep = [c for c in upload.columns if c not in {n for n, _ in features}]
    if "user_id" not in upload.columns:
        upload = with_row_index(upload, "_row").withColumn(
            "user_id", F.concat(F.lit(FALLBACK_ID_PREFIX), F.col("_row").cast("string"))
        ).drop("_row")
        keep = ["user_id"] + keep
    aligned = align_features(upload, features, keep=keep)
    scored = scorer(aligned)
    cols = []
    for c in REPORT_COLUMNS:
        if c == "prob_churn":
            cols.append(X.truncated_percent("proba").alias("prob_churn"))
        elif c in scored.columns:
            cols.append(F.col(c))
        elif c == "ciudad":
            cols.append(F.lit(UNKNOWN_CITY).alias(c))
        else:
            cols.append(F.lit(0).alias(c))
    return scored.select(*cols, X.predicted_class("proba").alias("pred_churn"))


def report_table(scored: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` rows by prob_churn (ties by id) (M3, L1)."""
    return scored.orderBy(F.col("prob_churn").desc(), F.col("user_id").asc()).limit(k)


def report_cities(scored: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` cities by mean prob_churn (ties by city) (A10): ciudad, prob_churn."""
    return (
        scored.groupBy("ciudad")
        .agg(F.avg("prob_churn").alias("prob_churn"))
        .orderBy(F.col("prob_churn").desc(), F.col("ciudad").asc())
        .limit(k)
    )


def report_summary(scored: DataFrame) -> DataFrame:
    """Rows, mean prob_churn and its complement to 100."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.avg("prob_churn").alias("promedio_churn"),
    ).withColumn("promedio_retencion", F.lit(100.0) - F.col("promedio_churn"))


def report_scatter(scored: DataFrame) -> DataFrame:
    """(ingreso_mensual_mxn, prob_churn) for every row (M3)."""
    return scored.select("ingreso_mensual_mxn", "prob_churn")


def batch_report(
    upload: DataFrame,
    scorer: Scorer = rule_scorer,
    features: Sequence[tuple[str, str]] = FEATURES,
    top_rows: int = 10,
    top_cities: int = 5,
) -> dict[str, DataFrame]:
    """The four parts of a batch scoring report over one upload (M3).

    ``table`` (top rows by probability), ``cities`` (top cities by mean),
    ``summary`` (rows, mean, complement) and ``scatter`` (income, probability).
    The scored frame is shared; pass a materialized upload when all four parts
    are collected, so the upload is read and scored once.
    """
    scored = scored_upload(upload, scorer, features)
    return {
        "table": report_table(scored, top_rows),
        "cities": report_cities(scored, top_cities),
        "summary": report_summary(scored),
        "scatter": report_scatter(scored),
    }


def save_churn_model(model: PipelineModel, features: Sequence[tuple[str, str]], path: str) -> None:
    """Store a fitted pipeline and its feature list under ``path`` (shared storage on a cluster).

    The pipeline goes through Spark ML's writer; the feature list is a small
    table next to it, so both are read back with Spark from any storage.
    """
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path.rstrip('/')}/pipeline")
    rows = [(i, name, kind) for i, (name, kind) in enumerate(features)]
    spark.createDataFrame(rows, "ordinal int, name string, kind string").coalesce(1).write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/features"
    )


def load_churn_model(path: str) -> tuple[PipelineModel, list[tuple[str, str]]]:
    """A pipeline and feature list stored by :func:`save_churn_model` (the model artifact of M2)."""
    spark = SparkSession.active()
    model = PipelineModel.load(f"{path.rstrip('/')}/pipeline")
    feats = spark.read.parquet(f"{path.rstrip('/')}/features").orderBy("ordinal").collect()
    return model, [(r.name, r.kind) for r in feats]

"""The samples of a manifest file, key by key from one VARIANT a record (see ``sources.files``).

Keys that are absent, null, empty, 0 or false count as not given where an alias or a default can take their place.  Nulls
and truth values inside choices are rendered "None", "True" and "False".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.sources.files import records
from quillon.sources.manifest import KNOWN, LETTERS, resolve_path


def _at(*names: str) -> list[Column]:
    return [F.expr(f"variant_get(record, '$.{n}', 'variant')") for n in names]


def _given(v: Column) -> Column:
    """The value, null where it is nothing."""
    return F.when(~F.to_json(v).isin('""', "0", "false", "null", "[]", "{}"), v)


def _text(v: Column) -> Column:
    """A value as text: "None", "True", "False", and whole numbers that were written with a point keep it."""
    plain, kind = v.cast("string"), F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "None").when(kind == "BOOLEAN", F.initcap(plain))
        .when(kind.rlike(r"^DECIMAL\(1?\d,0\)$"), F.concat(plain, F.lit(".0"))).otherwise(plain)
    )


def _optional(name: str) -> Column:
    """Trimmed text of a key, null if it is absent, null or blank."""
    v = _at(name)[0]
    return F.when(~F.is_variant_null(v), X.blank_to_null(_text(v)))


def _choices() -> Column:
    """Choices, else options, as a list or an object by key, else the keys A to E.  Text that holds JSON counts as what it holds."""
    given = F.coalesce(*map(_given, _at("choices", "options")))
    held = F.coalesce(F.try_parse_json(F.when(F.schema_of_variant(given) == "STRING", given.cast("string"))), given)
    listed = F.transform(held.try_cast("array<variant>"), lambda x: F.coalesce(_text(x), F.lit("None")))
    keyed = F.transform(
        F.array_sort(F.map_keys(held.try_cast("map<string,variant>"))),
        lambda k: F.concat(k, F.lit(". "), F.coalesce(_text(F.element_at(held.try_cast("map<string,variant>"), k)), F.lit("None"))),
    )
    letters = [F.when(~F.is_variant_null(v), F.concat(F.lit(f"{k}. "), _text(v))) for k, v in zip(LETTERS, _at(*LETTERS))]
    return F.coalesce(listed, keyed, F.array_compact(F.array(*letters)))


def samples(
    spark: SparkSession, path: str, image_root: str | None = None, limit: int | None = None, strict: bool = True,
    condition_text: str = "Reply with only {}.",
) -> DataFrame:
    """The samples of a manifest file with the aliases of its keys resolved.

    strict raises for records without image or prompt; otherwise they are left out and their numbers stay unused.
    Keys without a meaning of their own are swept into metadata, a JSON string, with the question, hint and target.
    """
    raw = records(spark, path, limit)
    image = F.coalesce(*map(_given, _at("image", "image_path", "img")))
    is_object = F.startswith(F.schema_of_variant(image), F.lit("OBJECT"))
    question = F.coalesce(*map(_given, _at("prompt", "question")))
    first = raw.select(
        "index", "record", _choices().alias("choices"), image.alias("image"), is_object.alias("is_object"),
        F.coalesce(X.blank_to_null(_text(question)), F.lit("")).alias("asked"), _optional("hint").alias("hint"), _optional("answer").alias("answer"),
    )
    prompt = X.prompt_with(F.nullif("asked", F.lit("")), F.col("hint"), F.col("choices"))
    file_name = F.when(F.col("is_object"), X.blank_to_null(F.expr("try_variant_get(image, '$.path', 'string')"))).otherwise(_text(F.col("image")))
    blob = F.when(F.col("is_object"), F.expr("try_variant_get(image, '$.bytes', 'binary')"))
    target = F.coalesce(_optional("attack_target"), X.default_target(F.col("answer"), F.col("choices")))
    lead, _, tail = condition_text.partition("{}")
    folder = path.rpartition("/")[0] or "."
    named = first.select(
        "index", "record", "choices", "answer", "hint", F.nullif(prompt, F.lit("")).alias("prompt"), target.alias("attack_target"), blob.alias("image_bytes"),
        resolve_path(file_name, image_root, folder).alias("image_path"),
    )
    ident = F.coalesce(*[_text(_given(v)) for v in _at("id", "sample_id")], F.format_string("sample_%05d", "index"))
    own = F.map_filter(F.expr("try_variant_get(record, '$', 'map<string,variant>')"), lambda k, _: ~k.isin(*(KNOWN - {"ord"})))
    asked = F.coalesce(_optional("question"), _optional("prompt"), F.col("prompt"))
    swept = F.struct(asked.alias("question_text"), "hint", "attack_target")
    rest = F.map_filter(F.from_json(F.to_json(swept), "map<string,string>"), lambda _, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(rest), k)), F.transform_values(rest, lambda _, v: v.cast("variant")))
    out = named.select(
        "index", ident.alias("sample_id"), "image_path", "image_bytes", "prompt", "answer", "attack_target",
        F.coalesce(_optional("attack_text"), F.concat(F.lit(lead), F.col("attack_target"), F.lit(tail))).alias("attack_text"),
        F.coalesce(_text(_given(_at("task_type")[0])), F.when(F.size("choices") > 0, "mcq").otherwise("open")).alias("task_type"),
        "choices", _optional("category").alias("category"), F.to_json(merged).alias("metadata"),
    )
    lacking = F.when(F.col("image_path").isNull() & F.col("image_bytes").isNull(), "image").when(F.col("prompt").isNull(), "prompt")
    if not strict:
        return out.where(lacking.isNull())
    message = F.concat(F.lit("record "), F.col("index").cast("string"), F.lit(" is missing: "), lacking)
    return out.withColumn("prompt", F.when(lacking.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("prompt")))

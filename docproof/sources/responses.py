"""Strict reading of extraction responses."""

from pyspark.sql import DataFrame, functions as F

from docproof.schema import FIELDS, RECORD
from docproof.session import require_settings


# The type of a sound response, as Spark spells it: known fields only, each text or null.
RECORD_TYPE = rf"\AOBJECT<(?:(?:{'|'.join(FIELDS)}): (?:STRING|VOID)(?:, |(?=>\z)))*>\z"

# How services write them: known fields only, each null or text without escapes, and no blanks between.
PLAIN = rf'\A\{{(?:"(?:{"|".join(FIELDS)})":(?:"[^"\\\x00-\x1f]*+"|null)(?:,(?=")|(?=\}}\z)))*+\}}\z'


def one_response_per_path(responses: DataFrame) -> DataFrame:
    """(path, output_text, n_responses): equal paths are merged before the shuffle, not collected.

    A response that was delivered more than once counts once; ``n_responses`` is 2 where a path
    has different ones.
    """
    last, first, texts = F.max("output_text"), F.min("output_text"), F.count("output_text")
    same = first.eqNullSafe(last) & ((texts == 0) | (texts == F.count(F.lit(1))))
    return responses.groupBy("path").agg(last.alias("output_text"), F.when(same, 1).otherwise(2).alias("n_responses"))


def ingest_responses(responses: DataFrame) -> DataFrame:
    """(path, ten fields, error) from (path, output_text); other columns are kept.

    A response must be exactly one JSON object with no unknown key, and every value text or
    null; missing keys are null. Spark's JSON functions ignore what follows the first value, so
    the text is parsed inside brackets and inside an object: only a lone value fits both. Where a
    pattern shows that the text is sound, which is about every one, it is parsed once and not so.
    """
    require_settings(responses.sparkSession)
    alone = F.json_object_keys(F.concat(F.lit('{"w":'), "_odd", F.lit("}"))) == F.array(F.lit("w"))
    plain = F.coalesce(F.is_valid_utf8("output_text") & F.rlike("output_text", F.lit(PLAIN)), F.lit(False))
    parsed = (
        responses.withColumn("_plain", plain)
        .withColumns({
            "_record": F.when(F.col("_plain"), F.from_json("output_text", RECORD)),
            "_odd": F.when(~F.col("_plain"), F.col("output_text")),
        })
        .withColumn(
            "_array",
            F.expr("try_variant_get(try_parse_json(concat('[', _odd, ']')), '$', 'array<variant>')"),
        )
        .withColumn("_value", F.when((F.size("_array") == 1) & alone, F.get("_array", F.lit(0))))
        .withColumn("_type", F.expr("schema_of_variant(_value)"))
    )
    # Only reached by values of another type.
    keys = F.expr("map_keys(try_variant_get(_value, '$', 'map<string,variant>'))")
    unknown = F.array_join(F.array_except(keys, F.array(*map(F.lit, FIELDS))), ", ")
    others = (
        F.when(keys.isNull(), "ResponseError: not a JSON object")
        .when(unknown != "", F.concat(F.lit("ResponseError: unknown field "), unknown))
        .otherwise("ResponseError: a field is not text")
    )
    sound = F.col("_plain") | F.coalesce(F.col("_type").rlike(RECORD_TYPE), F.lit(False))
    ready = parsed.withColumn("error", F.when(~sound, others))
    return ready.select(
        *[c for c in responses.columns if c != "output_text"],
        *[
            F.when(F.col("_plain"), F.col("_record")[f])
            .when(F.col("error").isNull(), F.expr(f"try_variant_get(_value, '$.{f}', 'string')")).alias(f)
            for f in FIELDS
        ],
        "error",
    )

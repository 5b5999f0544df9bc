"""Survey preparation: multi-select items, codebooks, constructs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syllabix.functions.joins import lookup_join
from syllabix.functions.ranks import MAX_GROUP_ROWS, group_sizes, running_total
from syllabix.functions.text import strip


def filter_activity(df: DataFrame, col: str = "lrn_activity_reference", pattern: str = "Pre_Survey") -> DataFrame:
    """Keep rows whose activity reference contains ``pattern``; a missing reference is dropped."""
    return df.filter(F.col(col).contains(pattern))


def drop_item_types(df: DataFrame, types: Sequence[str] = ("shorttext", "plaintext"), col: str = "lrn_type") -> DataFrame:
    """Remove free-text items; a missing type is dropped too."""
    return df.filter(~F.col(col).isin(list(types)))


def explode_multiselect(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    col: str = "response",
    sep: str = ",",
    out: str = "response_choice",
    max_group_rows: int = MAX_GROUP_ROWS,
    deal_by: Sequence[str] = (),
) -> DataFrame:
    """One row per selected choice, numbered 1..n inside ``keys`` as ``order``.

    ``order_by`` is the file order of the responses. Numbering continues across
    repeated submissions of a question. Missing and empty responses keep one row.
    Groups are counted on the responses as they come, by their separators; ``deal_by`` (some
    of ``keys``) then deals them out before they multiply.
    """
    # Plain character functions and a pattern without quoting: both run per row, and neither compiles a pattern there.
    parts = F.split(strip(F.translate(col, '[]"', "")), re.escape(sep))
    separators = F.length(col) - F.length(F.replace(F.col(col), F.lit(sep[0]), F.lit("")))
    sizes = group_sizes(df, keys, max_group_rows, F.coalesce(separators, F.lit(0)) + 1)
    dealt = df.repartition(*deal_by) if deal_by else df
    choices = dealt.select(*df.columns, F.posexplode_outer(parts).alias("_pos", out)).withColumn(out, strip(out))
    order = [F.col(c).asc_nulls_last() for c in (*order_by, "_pos")]
    return running_total(choices, keys, order, "order", max_group_rows=max_group_rows, sizes=sizes).drop("_pos")


def normalize_response(
    df: DataFrame,
    col: str = "response_choice",
    null_tokens: Sequence[str] = ("null", ""),
    numeric: bool = True,
    drop_missing: bool = True,
) -> DataFrame:
    """Turn null tokens into NULL, drop them, and read the rest as numbers.

    With ``drop_missing=False`` the rows stay, so that a later row count still
    includes them (the second study's rule, whose only token is ``null``).
    """
    value = F.when(~F.col(col).isin(list(null_tokens)), F.col(col))
    kept = df.withColumn(col, value)
    if drop_missing:
        kept = kept.filter(F.col(col).isNotNull())
    return kept.withColumn(col, F.col(col).try_cast("double")) if numeric else kept


def count_options(df: DataFrame, prefix: str = "lrn_option_", out: str = "num_response_options") -> DataFrame:
    """Number of filled answer options of each codebook row."""
    options = [F.col(c).isNotNull().cast("bigint") for c in df.columns if c.startswith(prefix)]
    return df.withColumn(out, reduce(lambda a, b: a + b, options, F.lit(0).cast("bigint")))


def join_codebook(
    items: DataFrame,
    codebook: DataFrame,
    keys: Sequence[str] = ("release", "lrn_question_reference", "order"),
    default_order: int | None = None,
) -> DataFrame:
    """Attach codebook columns to items; clashing names end in ``_survey_data`` / ``_codebook``.

    Without ``release`` among the keys both releases are kept (the codebook's as
    ``release_codebook``) and an item may match several codebook releases.
    ``default_order`` replaces a missing codebook position.
    """
    wanted = ["release", "lrn_question_reference", "order", "variable_name", "prompt", "lrn_type", "num_response_options"]
    book = codebook.select(*wanted)
    if default_order is not None:
        book = book.fillna({"order": default_order})
    book = book.withColumnsRenamed({"prompt": "prompt_codebook", "lrn_type": "lrn_type_codebook"})
    if "release" not in keys:
        book = book.withColumnRenamed("release", "release_codebook")
    left = items.withColumnsRenamed({"prompt": "prompt_survey_data", "lrn_type": "lrn_type_survey_data"})
    return lookup_join(left, book, list(keys))


def label_codes(
    df: DataFrame,
    mapping: Mapping[str, Mapping[str, str]],
    var_col: str = "variable_name",
    code_col: str = "response_choice",
    out: str = "response_label",
) -> DataFrame:
    """Keep the variables named in ``mapping`` (names trimmed) and translate their codes.

    A code without an entry gets a missing label.
    """
    named = df.withColumn(var_col, strip(var_col)).filter(F.col(var_col).isin(list(mapping)))
    code = F.when(F.col(code_col) == F.floor(code_col), F.col(code_col).cast("bigint").cast("string"))
    label = F.lit(None).cast("string")
    for variable, codes in mapping.items():
        table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
        label = F.when(F.col(var_col) == variable, F.try_element_at(table, code)).otherwise(label)
    return named.withColumn(out, label)


def collapse_multiselect(
    df: DataFrame,
    match: str = "ma_prep",
    keys: Sequence[str] = ("student_id", "class_id", "lrn_question_reference"),
    order_by: Sequence[str] = ("order",),
    new_var: str = "ma_prep_combined",
    n_options: int = 4,
    raw_col: str = "response",
) -> DataFrame:
    """Replace the selected options of a multi-select question by one summary row.

    Per ``keys`` the first row (by ``order_by``) stays, its choice becomes the
    number of rows, and the raw response becomes the list of chosen variables. All
    other rows pass with their raw response as a one-element list. Rows without a
    variable fall out. A numbered item matches at most its codebook rows, so a
    group, and with it the list, is no longer than the codebook. One pass over the
    items serves both kinds of rows.
    """
    of_question = Window.partitionBy(*keys, "_match")
    by_order = of_question.orderBy(*[F.col(c).asc_nulls_last() for c in (*order_by, "variable_name")])
    whole = by_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    matched = F.col("_match")
    marked = (
        df.filter(F.col("variable_name").isNotNull())
        .withColumn("_match", F.col("variable_name").contains(match))
        .withColumns({
            "_nth": F.row_number().over(by_order),
            "_rows": F.count(F.lit(1)).over(of_question),
            "_names": F.collect_list(F.when(matched, F.col("variable_name"))).over(whole),
        })
        .filter(~matched | (F.col("_nth") == 1))
    )
    replaced = {
        "variable_name": F.when(matched, F.lit(new_var)).otherwise(F.col("variable_name")),
        "num_response_options": F.when(matched, F.lit(n_options)).otherwise(F.col("num_response_options")).cast("bigint"),
        "response_choice": F.when(matched, F.col("_rows")).otherwise(F.col("response_choice").try_cast("double")),
        raw_col: F.when(matched, F.col("_names")).otherwise(F.array(raw_col)),
    }
    return marked.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns])


def attach_construct(
    df: DataFrame,
    lookup: DataFrame,
    overrides: Mapping[str, str] | None = None,
    drop_unmapped: bool = True,
) -> DataFrame:
    """Attach each item's construct; ``overrides`` sets it by variable name.

    With ``drop_unmapped`` items without a construct are removed.
    """
    joined = lookup_join(df, lookup.withColumnRenamed("id", "variable_name"), ["variable_name"])
    for variable, construct in (overrides or {}).items():
        joined = joined.withColumn(
            "construct", F.when(F.col("variable_name") == variable, F.lit(construct)).otherwise(F.col("construct"))
        )
    return joined.filter(F.col("construct").isNotNull()) if drop_unmapped else joined


def prompt_drift(
    df: DataFrame,
    keys: Sequence[str] = ("variable_name", "prompt_codebook", "question"),
    a: str = "prompt_codebook",
    b: str = "question",
) -> DataFrame:
    """Rows per item, among items with a construct, whose two wordings differ."""
    return (
        df.filter(F.col("construct").isNotNull() & (F.col(a) != F.col(b)))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def construct_coverage(df: DataFrame, mapped: bool) -> DataFrame:
    """Rows per (construct, item, wording): answered items with a construct, or items without one."""
    has = F.col("construct").isNotNull()
    keep = has & F.col("response_choice").isNotNull() if mapped else ~has
    return df.filter(keep).groupBy("construct", "variable_name", "prompt_codebook").agg(F.count(F.lit(1)).alias("n"))


def rescale_likert(
    df: DataFrame,
    col: str = "response_choice",
    out: str = "response_rescaled",
    lowest: float = 0.0,
) -> DataFrame:
    """Rescale answers to 0-1 by the item's number of scale values and reverse flipped items.

    The lowest code is ``lowest``; ``scale_values`` and ``scale_flipped`` come from
    the construct lookup. A one-value scale gives NULL.
    """
    unit = F.try_divide(F.col(col) - F.lit(lowest), F.col("scale_values").cast("double") - 1)
    return df.withColumn(out, F.when(F.col("scale_flipped"), 1 - unit).otherwise(unit))

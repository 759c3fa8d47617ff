"""Label directories: `<root>/<scenario>/<scenario>_<idx>_label_<serial>.json` and variants.

Listing (names only), resolution (which file belongs to which case) and content are separate steps, so
that index filters run on file names before any document is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import vocab
from caseflow.functions.text import clean_distinct, is_blank
from caseflow.functions.variants import (
    child,
    first_truthy_text,
    get,
    is_absent,
    is_array,
    is_object,
    number_of,
    path_of,
    string_of,
    stripped_text,
)
from caseflow.sources.files import NameFilter, in_ranges, index_ranges, list_tree, qualified, read_texts


# --- files ------------------------------------------------------------------------------------
def decoded(path: Column) -> Column:
    """File paths arrive percent-encoded; a literal plus sign stays one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_columns(path: Column) -> list[Column]:
    parts = F.split(path, "/")
    return [
        path.alias("path"),
        F.element_at(parts, -2).alias("scenario"),
        F.element_at(parts, -1).alias("file_name"),
    ]


def list_files(spark: SparkSession, root: str, scenario: str = "all", recursive: bool = False) -> DataFrame:
    """Paths of the JSON files of all scenarios, or of one. Contents are not read.

    Tasks list the directories. One scenario is a narrower path, so the other directories are not even listed. A missing
    directory is an error, as is a root without any. Where only Spark's readers reach the root, Spark lists it.
    """
    known = qualified(spark, root)
    if known is not None:
        one = scenario != "all" and not recursive
        paths = list_tree(spark, f"{known}/{scenario}" if one else known, ".json", recursive, folders=not one)
        return paths.select(*file_columns(F.col("path")))
    folder = f"{root}/*" if scenario == "all" else f"{root}/{scenario}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.json")
    if recursive:
        reader, folder = reader.option("recursiveFileLookup", "true"), root
    return reader.load(folder).select(decoded(F.col("path")).alias("path")).select(*file_columns(F.col("path")))


def read_documents(spark: SparkSession, root: str, scenario: str = "all", recursive: bool = False, only: NameFilter | None = None) -> DataFrame:
    """Whole JSON files as text: path, scenario, file_name, body.

    `only(scenario, file_name)` is a condition on the names. It is a filter on file metadata, which Spark applies to the
    listing, so that files it leaves out are not opened.
    """
    folder = f"{root}/*" if scenario == "all" else f"{root}/{scenario}"
    reader = spark.read.option("pathGlobFilter", "*.json")
    if recursive:
        reader, folder = reader.option("recursiveFileLookup", "true"), root
    raw = reader.text(folder, wholetext=True)
    if only is not None:
        parts = F.split(decoded(F.col("_metadata.file_path")), "/")
        raw = raw.filter(only(F.element_at(parts, -2), F.element_at(parts, -1)))
    raw = raw.select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("body"))
    return raw.select(*file_columns(F.col("path")), "body")


def scenarios(files: DataFrame) -> DataFrame:
    return files.select("scenario").distinct()


def is_label_name(file_name: Column) -> Column:
    return F.lower(file_name).contains("label")


def label_files(files: DataFrame) -> DataFrame:
    """Files whose name contains "label" in any letter case (for serial-number backfill)."""
    return files.filter(is_label_name(F.col("file_name")))


def read_label_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents of all label files below `root`, at any depth; other files are listed and not opened."""
    known = qualified(spark, root)
    if known is not None:
        return read_texts(label_files(list_files(spark, root, recursive=True)), known)
    return read_documents(spark, root, recursive=True, only=lambda _scenario, name: is_label_name(name))


# --- index and path resolution ----------------------------------------------------------------
def index_from_name(file_name: Column, scenario: Column) -> Column:
    """Case index of a label file: `<scenario>_<idx>_label_*.json`, else any `_<idx>_label_`."""
    rest = F.when(
        F.startswith(file_name, F.concat(scenario, F.lit("_"))),
        F.substring(file_name, F.length(scenario) + 2, F.length(file_name)),
    )
    anchored = F.regexp_extract(rest, r"^(\d+)_label_.*\.json$", 1)
    loose = F.regexp_extract(file_name, vocab.LOOSE_INDEX, 1)
    return F.coalesce(F.nullif(anchored, F.lit("")), F.nullif(loose, F.lit(""))).try_cast("bigint")


def discover(files: DataFrame) -> DataFrame:
    """One label file per (scenario, idx): the first by path. Pre-aggregated, no sort."""
    named = files.filter(F.col("file_name").rlike(r"_label_.*\.json$")).withColumn(
        "idx", index_from_name(F.col("file_name"), F.col("scenario"))
    )
    return named.filter(F.col("idx").isNotNull()).groupBy("scenario", "idx").agg(F.min("path").alias("label_path"))


def match_names(file_name: Column, scenario: Column, names) -> Column:
    """struct(pri, idx) of the first naming pattern that fits, or null."""
    prefix = F.concat(scenario, F.lit("_"))
    rest = F.when(
        F.startswith(file_name, prefix), F.substring(file_name, F.length(scenario) + 2, F.length(file_name))
    )
    match = None
    for priority, (prefixed, pattern) in enumerate(names):
        subject = rest if prefixed else file_name
        idx = F.regexp_extract(subject, pattern, 1)
        hit = F.coalesce(idx != "", F.lit(False))
        value = F.struct(F.lit(priority).alias("pri"), idx.try_cast("bigint").alias("idx"))
        match = F.when(hit, value) if match is None else match.when(hit, value)
    return match


def resolve_paths(files: DataFrame) -> DataFrame:
    """label_path and case_path per (scenario, idx): best pattern first, then first path.

    A case without its own file uses the label file; an index without a label file has outcome
    `unresolved` and no label_path.
    """
    roles = files.select(
        "scenario",
        "path",
        F.explode(
            F.array(
                F.struct(F.lit("label").alias("role"), match_names(F.col("file_name"), F.col("scenario"), vocab.LABEL_NAMES).alias("m")),
                F.struct(F.lit("case").alias("role"), match_names(F.col("file_name"), F.col("scenario"), vocab.CASE_NAMES).alias("m")),
            )
        ).alias("r"),
    ).filter(F.col("r.m").isNotNull())
    rank = F.struct(F.col("r.m.pri"), F.col("path"))

    def best(role: str) -> Column:
        return F.min(F.when(F.col("r.role") == role, rank))["path"]

    found = roles.groupBy("scenario", F.col("r.m.idx").alias("idx")).agg(
        best("label").alias("label_path"), best("case").alias("own_case_path")
    )
    return found.select(
        "scenario",
        "idx",
        "label_path",
        F.coalesce("own_case_path", "label_path").alias("case_path"),
        F.when(F.col("label_path").isNull(), "unresolved").otherwise("resolved").alias("outcome"),
    )


# --- content ----------------------------------------------------------------------------------
def with_document(df: DataFrame, body: str = "body") -> DataFrame:
    """Add `doc` (VARIANT); it is null for text that is not JSON."""
    return df.withColumn("doc", F.try_parse_json(F.col(body)))


def split_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable records, quarantine). Failing fast is `require_none(quarantine)`."""
    return df.filter(F.col("doc").isNotNull()), df.filter(F.col("doc").isNull()).drop("doc")


def require_none(problems: DataFrame, what: str) -> None:
    """Raise when there is any row; shows at most five of them."""
    shown = problems.limit(5).collect()
    if shown:
        raise ValueError(f"{what}: {shown}")


def semantic_labels(doc: Column) -> Column:
    """`semantic_labels` when it is an object, else an empty object. The test is on the document, so that only the result is a copy."""
    sem = child(doc, "semantic_labels")
    return F.when(get(doc, path_of("semantic_labels"), "struct<>").isNotNull(), sem).otherwise(F.parse_json(F.lit("{}")))


def root_cause(doc: Column) -> Column:
    """Training truth: the text itself, or category / name / root_cause of an object."""
    value = child(doc, "root_cause")
    return F.when(is_object(value), first_truthy_text(value, "category", "name", "root_cause")).otherwise(
        F.coalesce(get(value, "$", "string"), F.lit(""))
    )


def ground_truth(doc: Column) -> Column:
    """Evaluation truth: only `category` of an object, stripped; '' when missing."""
    value = child(doc, "root_cause")
    return F.coalesce(
        F.when(is_object(value), stripped_text(child(value, "category"))).otherwise(stripped_text(value)), F.lit("")
    )


def candidate_values(doc: Column) -> Column:
    """Candidates as given (array of VARIANT); null when missing, empty or not a list."""
    values = get(doc, "$.root_cause_candidates", "array<variant>")
    return F.when(F.size(values) > 0, values)


def candidates(doc: Column) -> Column:
    """Candidates as text; without a list the root cause is the only candidate."""
    rc = root_cause(doc)
    listed = F.transform(candidate_values(doc), lambda v: get(v, "$", "string"))
    return F.coalesce(listed, F.when(rc != "", F.array(rc)), F.array().cast("array<string>"))


def candidate_categories(doc: Column) -> Column:
    """Candidate names: object `category` or the scalar, stripped, non-empty, ordered distinct."""
    names = F.transform(
        candidate_values(doc),
        lambda v: F.when(is_object(v), get(v, "$.category", "string")).otherwise(get(v, "$", "string")),
    )
    return clean_distinct(F.filter(names, lambda n: n.isNotNull()))


def sop_value(doc: Column) -> Column:
    """Operating procedure: the nested one unless it is missing or blank, else the top-level one."""
    nested = child(doc, "semantic_labels", "sop")
    usable = ~is_absent(nested) & F.coalesce(string_of(nested), F.lit("x")).rlike(r"(?U)\S")
    return F.when(usable, nested).otherwise(child(doc, "sop"))


def sop_text(value: Column) -> Column:
    """Text of an operating procedure: stripped string, JSON of a non-empty object or list, else ''."""
    empty = F.coalesce(get(value, "$", "string").isin("{}", "[]"), F.lit(False))
    nested = F.when(is_object(value) | is_array(value), F.when(~empty, F.to_json(value)))
    return F.coalesce(nested, F.when(is_absent(value) | empty, F.lit("")), stripped_text(value), F.lit(""))


def project_cases(labels: DataFrame) -> DataFrame:
    """Flatten documents to the case table. Needs scenario, idx, doc; other columns pass through.

    Store the result before filtering on its columns: the planner pushes such a filter below this projection
    and would then parse every document again for the filter.
    """
    doc = F.col("doc")
    sem = semantic_labels(doc)
    return labels.select(
        *[c for c in labels.columns if c not in ("doc", "body")],
        number_of(child(doc, "alarm_time")).alias("alarm_time_ms"),
        sop_text(sop_value(doc)).alias("sop"),
        candidates(doc).alias("candidates"),
        candidate_categories(doc).alias("categories"),
        root_cause(doc).alias("root_cause"),
        ground_truth(doc).alias("groundtruth"),
        sem.alias("sem"),
    )


def load_cases(spark: SparkSession, root: str, selected: DataFrame | None = None, scenario: str = "all") -> DataFrame:
    """Read, resolve and flatten the cases of a label root; `selected` (scenario, idx) keeps only those.

    Tasks open the label files of the selection and no others. Where only Spark's readers reach the root, the selection
    becomes index ranges in the file filter; with too many runs of indices the ranges cover more, and the join with the
    selection leaves only what was asked for.
    """
    paths = resolve_paths(list_files(spark, root, scenario)).filter(F.col("outcome") == "resolved")
    if selected is not None:
        wanted = selected.select("scenario", "idx").distinct()
        paths = paths.join(wanted, ["scenario", "idx"], "left_semi")
    known = qualified(spark, root)
    if known is not None:
        return project_cases(with_document(read_texts(paths.drop("outcome"), known, "label_path")))
    only = None
    if selected is not None:
        ranges = index_ranges(wanted)
        if ranges is not None:
            only = lambda s, name: in_ranges(ranges, s, match_names(name, s, vocab.LABEL_NAMES)["idx"])
    docs = read_documents(spark, root, scenario, only=only).select(F.col("path").alias("label_path"), "body")
    joined = with_document(paths.join(docs, "label_path"))
    return project_cases(joined.drop("outcome"))


def has_sop(sop: Column) -> Column:
    return ~is_blank(sop)


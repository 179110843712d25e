"""Payloads: JSON text from models and configurations, read by the types it really has. All are built-in expressions.

A value of JSON is a VARIANT column; text that is no JSON counts as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import strip_fences, unique_ci

# Keys under which payloads name things.
NAME_KEYS = ["name", "label", "text", "value", "entity"]
OBJECT_KEYS = ["detected_objects", "objects", "visible_objects", "people", "entities", "text", "actions", "setting"]
LABEL_KEYS = ["objects", "entities", "items", "detections"]
TEXT_KEYS = ["caption", "text", "ocr", "description", "summary"]
# Names of secrets, and of references to secrets, which may stand in a configuration.
SECRET_KEYS = ["access_token", "accesskey", "account_key", "api_key", "apikey", "client_secret", "clientsecret", "connection_string", "connectionstring", "id_token", "password", "refresh_token", "sas_token", "secret", "storage_account_key", "token"]
SECRET_REFERENCES = ["api_key_env", "api_key_secret_key", "api_key_secret_scope"]
# The stages of a run and how far along each is.
STAGE_PROGRESS = {
    "register_manifest": 0.10, "validate_and_probe_media": 0.20, "extract_audio_assets": 0.30, "extract_frame_assets": 0.40, "run_florence_frame_analysis": 0.50, "run_faster_whisper_asr": 0.55,
    "detect_scenes_and_windows": 0.62, "run_databricks_scene_reasoning": 0.76, "build_gold_processing_result": 0.86, "build_graph_upserts": 0.92, "project_neo4j_graph": 0.96, "publish_outbox": 1.00,
}
NO_STRINGS = "array<string>"


def value(text: Column) -> Column:
    return F.try_parse_json(F.nullif(text, F.lit("")))


def kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT or another type; null for nothing and for JSON's null."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))


def field(v: Column, key: str) -> Column:
    return F.when(kind(v) == "OBJECT", F.try_variant_get(v, f"$.{key}", "variant"))


def _fields(v: Column, keys: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, keys)), lambda k: F.try_variant_get(v, F.concat(F.lit("$."), k), "variant"))


def string(v: Column) -> Column:
    """A trimmed string that isn't blank; null for anything else."""
    return F.when(kind(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))


def items(v: Column) -> Column:
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def object_text(text: Column) -> Column:
    """JSON text of an object; ``{}`` for anything else."""
    v = value(text)
    return F.when(kind(v) == "OBJECT", F.to_json(v)).otherwise("{}")


def list_text(text: Column) -> Column:
    """JSON text of a list; ``[]`` for anything else."""
    v = value(text)
    return F.when(kind(v) == "ARRAY", F.to_json(v)).otherwise("[]")


def string_field(v: Column, keys: list[str]) -> Column:
    return F.coalesce(*[string(field(v, k)) for k in keys])


def strings(v: Column, depth: int = 2) -> Column:
    """The strings in a value: itself, an object's names, or those of a list's elements, lists in lists to ``depth``."""
    whole, named = string(v), F.array_compact(F.transform(_fields(v, NAME_KEYS), string))
    out = F.when(whole.isNotNull(), F.array(whole)).when(kind(v) == "OBJECT", named)
    if depth:
        out = out.when(kind(v) == "ARRAY", F.flatten(F.transform(items(v), lambda x: strings(x, depth - 1))))
    return out.otherwise(F.array().cast(NO_STRINGS))


def objects(v: Column, most: int = 25) -> Column:
    """What a payload says is to be seen, key by key, distinct whatever the case."""
    return unique_ci(F.flatten(F.transform(_fields(v, OBJECT_KEYS), lambda x: strings(x))), most)


def labels(v: Column, most: int = 50) -> Column:
    """The labels of a structured payload: its list of labels, or else the strings under other keys; of a list its strings."""
    listed = F.transform(items(field(v, "labels")), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None")))
    other = F.flatten(F.transform(_fields(v, LABEL_KEYS), lambda x: strings(x)))
    found = F.when(kind(field(v, "labels")) == "ARRAY", listed).when(kind(v) == "OBJECT", other).when(kind(v) == "ARRAY", strings(v))
    return unique_ci(F.coalesce(found, F.array().cast(NO_STRINGS)), most)


def caption(v: Column) -> Column:
    """The text of a payload: itself, the first of its texts, or its labels joined; null without any."""
    joined = F.array_join(F.filter(F.transform(items(field(v, "labels")), lambda x: F.trim(F.try_variant_get(x, "$", "string"))), lambda x: x != ""), ", ")
    return F.coalesce(string(v), string_field(v, TEXT_KEYS), F.nullif(joined, F.lit("")))


def task_fields(task: Column, v: Column) -> dict[str, Column]:
    """What a model of pictures said, by its task: a text for captions and OCR, JSON for objects, regions and where things are.

    JSON is compact, with sorted keys; an empty or missing payload is ``{}``.
    """
    empty = v.isNull() | kind(v).isNull() | F.to_json(v).isin("{}", "[]", '""', "0", "false")
    said = F.when(empty, F.lit("{}")).otherwise(F.to_json(v))
    only = lambda *tasks: F.when(task.isin(*tasks), said).otherwise("{}")
    return {
        "caption": F.when(task == "caption", caption(v)), "ocr_text": F.when(task == "ocr", caption(v)),
        "objects_json": only("object_detection"), "regions_json": only("dense_region_caption"), "grounding_json": only("object_detection", "dense_region_caption"),
    }


def model_json(text: Column) -> Column:
    """The object in a model's answer, with or without a fence around it."""
    return object_text(strip_fences(text))


def message_text(v: Column) -> Column:
    """The content of a chat message: a string, or the text parts of a list, one a line."""
    content = field(v, "content")
    parts = F.transform(items(content), lambda x: string(field(x, "text")))
    return F.coalesce(string(content), F.nullif(F.array_join(parts, "\n"), F.lit("")))


def bool_of(text: Column, default: bool) -> Column:
    """1, true, yes, on and their opposites whatever the case; null is the default; anything else is an error."""
    low = F.lower(F.trim(text))
    wrong = F.raise_error(F.concat(F.lit("no boolean: "), text)).cast("boolean")
    return F.when(text.isNull(), default).when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False).otherwise(wrong)


def bounded(v: Column, default: float, least: float, most: float, name: str = "value") -> Column:
    """The value or, for null, its default; outside of its bounds it is an error."""
    x = F.coalesce(v, F.lit(default))
    return F.when(x.between(least, most), x).otherwise(F.raise_error(F.lit(f"{name} must be between {least} and {most}")).cast("double"))


def string_set(text: Column) -> Column:
    """The distinct entries of a list with commas, trimmed, lower-cased and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def metadata_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def merged(a: Column, b: Column) -> Column:
    """Both maps; the second one's values win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def is_secret(key: Column) -> Column:
    """Whether a key names a secret itself and no reference to one."""
    low = F.lower(key)
    bare = F.regexp_replace(low, "[^a-z0-9]", "")
    named = bare.isin([k.replace("_", "") for k in SECRET_KEYS]) | F.rlike(bare, F.lit("(apikey|token|accountkey)$|password|connectionstring|clientsecret"))
    return named & ~F.replace(low, F.lit("-"), F.lit("_")).isin(SECRET_REFERENCES)


def secret_paths(text: Column, depth: int = 3) -> Column:
    """The paths of all keys in a configuration that name secrets, sorted; lists are gone through."""

    def walk(v: Column, path: Column, depth: int) -> Column:
        keys = F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast(NO_STRINGS))
        here = F.when(kind(v) == "OBJECT", keys).otherwise(F.array().cast(NO_STRINGS))
        at = lambda k: F.concat_ws(".", F.nullif(path, F.lit("")), k)
        own = F.transform(F.filter(here, is_secret), at)
        if not depth:
            return own
        inner = F.flatten(F.transform(here, lambda k: walk(F.try_variant_get(v, F.concat(F.lit("$['"), k, F.lit("']")), "variant"), at(k), depth - 1)))
        listed = F.flatten(F.transform(items(v), lambda x, i: walk(x, F.concat(path, F.lit("["), i, F.lit("]")), depth - 1)))
        return F.concat(own, inner, listed)

    return F.array_sort(walk(value(text), F.lit(""), depth))


def filtered(text: Column, allowed: list[str]) -> Column:
    """Of an object the allowed keys whose values are scalars, as a map of JSON texts."""
    whole = F.from_json(object_text(text), "map<string,string>")
    return F.map_filter(whole, lambda k, v: k.isin(allowed) & ~F.coalesce(F.rlike(v, F.lit(r"^\s*[\[{]")), F.lit(False)))


def flat_properties(df: DataFrame) -> DataFrame:
    """Every column a scalar or a list of scalars: anything deeper becomes JSON text."""
    simple = lambda t: not t.startswith(("array", "map", "struct"))
    flat = {c: F.transform(c, lambda x: F.to_json(x)) if t.startswith(("array<struct", "array<map")) else F.to_json(F.col(c)) for c, t in df.dtypes if not simple(t) and not (t.startswith("array<") and simple(t[6:-1]))}
    return df.withColumns(flat) if flat else df


def canonical(columns: dict[str, Column]) -> Column:
    """Compact JSON with its keys in order; nulls are kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def stable_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical(columns).cast("binary"), 256)


def progress(stage: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, stage), F.lit(0.0))


def timestamp_of(timestamp: Column, start: Column) -> Column:
    return F.coalesce(timestamp.cast("double"), start.cast("double"), F.lit(0.0))


def level_of(kinds: Column) -> Column:
    """The highest level among a node's labels."""
    levels = [("Video", "video"), ("Chapter", "chapter"), ("Scene", "scene"), ("Frame", "frame")]
    return reduce(lambda c, x: c.when(F.array_contains(kinds, x[0]), x[1]), levels, F).otherwise("unknown")


def text_field(kind_: Column) -> Column:
    return F.when(kind_ == "Entity", "name").when(kind_ == "AudioSegment", "text").otherwise("description")


def preview(v: Column, keys: list[str], most: int = 1400) -> Column:
    """JSON of the first of the keys that is there, or else of the whole, cut."""
    return F.substring(F.coalesce(*[F.to_json(field(v, k)) for k in keys], F.to_json(v)), 1, most)


def close_hashes(a: Column, b: Column, most: int = 12) -> Column:
    """Whether two perceptual hashes differ in few bits."""
    return F.bit_count(a.bitwiseXOR(b)) <= most

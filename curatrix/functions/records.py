"""Shaping of question-answering records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import folded, strip

LETTERS = ("A", "B", "C", "D", "E")
# Fixed value: the instruction that opens evaluation and training prompts.
INSTRUCTION = "You will solve a problem/request. You should provide your thoughts within <think> </think> tags before providing the answer.\nWrite your final answer within <answer> </answer> tags."


def options_map(c: Column) -> Column:
    """Options of a JSON object, in its order; null if it is no object."""
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False)), F.from_json(c, "map<string,string>"))


def options_text(c: Column) -> Column:
    """``K. text`` lines by key of a JSON object, null options skipped; otherwise the text itself, stripped."""
    entries = F.array_sort(F.filter(F.map_entries(options_map(c)), lambda e: e["value"].isNotNull()))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")
    return F.coalesce(lines, strip(c), F.lit(""))


def record_text(*parts: Column) -> Column:
    """Non-empty parts joined by a line break."""
    return F.concat_ws(" \n ", *(F.nullif(p, F.lit("")) for p in parts))


def as_list(c: Column) -> Column:
    """Null is the empty list; null elements are empty texts."""
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))


def context_lookup(contexts: Column, key: Column) -> Column:
    """Texts of one key of a map or of a list of maps, in order, each once."""
    return F.array_distinct(as_list(F.try_element_at(contexts, key)))


def composite_key(article: Column, image_ids: Column, file_names: Column) -> Column:
    return F.struct(F.coalesce(article, F.lit("")).alias("article"), as_list(image_ids).alias("image_ids"), as_list(file_names).alias("file_names"))


def option_struct(vqa: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    return F.struct(*(vqa["options"][x].alias(x) for x in letters))


def normalize_vqa(vqa: Column) -> Column:
    """Question and answer as texts, options A to E; null if there is no pair."""
    return F.when(vqa.isNotNull(), F.struct(vqa["question"].alias("question"), option_struct(vqa).alias("options"), vqa["answer"].alias("answer")))


def option_by_letter(vqa: Column, letter: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    return F.coalesce(*(F.when(letter == x, vqa["options"][x]) for x in letters))


def valid_strict(vqa: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    """Question, every option and an answer letter are there."""
    ok = vqa["question"].isNotNull() & vqa["answer"].isin(*letters)
    for x in letters:
        ok = ok & vqa["options"][x].isNotNull()
    return F.coalesce(ok, F.lit(False))


def valid_loose(vqa: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    """Question and an answer letter are there; options may hold anything."""
    return F.coalesce(vqa["question"].isNotNull() & vqa["options"].isNotNull() & vqa["answer"].isin(*letters), F.lit(False))


def train_fields(vqa: Column, letters: tuple[str, ...] = LETTERS) -> tuple[Column, Column, Column, Column]:
    """(question, options as JSON, answer letter, answer text) of a training record; nulls if it has no letter."""
    values = F.struct(*(F.coalesce(vqa["options"][x], F.lit("")).alias(x) for x in letters))
    ok = vqa["question"].isNotNull() & vqa["answer"].isin(*letters)
    pick = F.coalesce(option_by_letter(vqa, vqa["answer"], letters), F.lit(""))
    return F.when(ok, vqa["question"]), F.when(ok, F.to_json(values)), F.when(ok, vqa["answer"]), F.when(ok, pick)


def permuted_options(vqa: Column, target: Column, letters: tuple[str, ...] = LETTERS) -> Column:
    """Options with the right one under ``target`` and the others in their order under the remaining letters."""
    source, goal = (F.array_position(F.array(*(F.lit(x) for x in letters)), c) for c in (vqa["answer"], target))
    texts = F.array(*(vqa["options"][x] for x in letters))
    rest = F.filter(texts, lambda _, i: i + 1 != source)
    at = lambda k: F.when(goal == k, F.get(texts, source.cast("int") - 1)).otherwise(F.get(rest, F.when(goal < k, F.lit(k - 2)).otherwise(F.lit(k - 1))))
    return F.struct(*(at(k).alias(x) for k, x in enumerate(letters, 1)))


def resized(width: Column, height: Column, longest: int = 384) -> Column:
    """Size of an image scaled down to a longest side; never enlarged, never below one pixel."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale)).cast("int")
    return F.array(side(width), side(height))


def small_side(width: Column, height: Column, least: int = 28) -> Column:
    return F.least(width, height) < least


def fitted(width: Column, height: Column, least: int = 28, mode: str = "drop") -> Column:
    """Size of a picture whose shorter side must reach ``least``: ``drop`` gives null for smaller ones, ``pad`` widens the
    short sides, ``resize`` enlarges both by one factor."""
    if mode == "drop":
        return F.when(~small_side(width, height, least), F.array(width, height))
    if mode == "pad":
        return F.array(F.greatest(width, F.lit(least)), F.greatest(height, F.lit(least)))
    scale = F.greatest(F.lit(1.0), F.lit(float(least)) / F.least(width, height))
    return F.array(*(F.ceil(F.round(x * scale, 6)).cast("int") for x in (width, height)))


def prompt_text(question: Column, options: Column, instruction: str | None = INSTRUCTION) -> Column:
    """Prompt with the options in their JSON order."""
    lines = F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(F.lit("\n\n"), e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("None")))), "")
    body = F.concat(F.lit("Question: "), F.coalesce(question, F.lit("None")), F.lit("\n\nOptions:"), lines)
    return F.concat(F.lit(instruction + "\n\n"), body) if instruction else body


# Fixed values in the layouts below: the marks of the model families' chat formats.
def chat_prompt(text: Column, n_images: Column, style: str = "plain") -> Column:
    """Prompt in the chat layout of a model family: ``qwen``, ``glm``, ``gemma`` or ``plain``."""
    n = F.coalesce(n_images, F.lit(0))
    if style == "qwen":
        pictures = F.when(n > 0, F.concat(F.lit("<|vision_start|>"), F.repeat(F.lit("<|image_pad|>"), n), F.lit("<|vision_end|>"))).otherwise("")
        return F.concat(F.lit("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n"), pictures, text, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    if style == "glm":
        return F.concat(F.lit("[gMASK]<sop><|user|>\n"), F.repeat(F.lit("<|begin_of_image|><|image|><|end_of_image|>"), n), text, F.lit("<|assistant|>\n"))
    if style == "gemma":
        return F.concat(F.lit("<bos><start_of_turn>user\n"), F.repeat(F.lit("<start_of_image>"), n), text, F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    return F.concat(F.repeat(F.lit("<image>\n"), n), text)


def response_text(reasoning: Column, label: Column) -> Column:
    return F.concat(F.lit("<think> "), strip(reasoning), F.lit(" </think>\n<answer> "), strip(label), F.lit(" </answer>"))


def caption_block(captions: Column) -> Column:
    """One ``[Image i] text`` line a caption; ``N/A`` without any."""
    c = F.coalesce(captions, F.array().cast("array<string>"))
    lines = F.transform(c, lambda x, i: F.concat(F.lit("[Image "), (i + 1).cast("string"), F.lit("] "), F.coalesce(F.nullif(strip(x), F.lit("")), F.lit("(empty)"))))
    return F.when(F.size(c) == 0, "N/A").otherwise(F.array_join(lines, "\n"))


def filled(template: str, **values: Column) -> Column:
    """A template whose ``{name}`` marks are replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def stripped_label(c: Column) -> Column:
    return F.regexp_replace(c, r"^[A-Za-z]\s*[.)]\s*", "")


def options_lines(options: Column) -> Column:
    """Lettered lines of options given as a JSON object, a JSON list or lines parted by breaks, ``;`` or ``|``."""
    kind = F.schema_of_variant(F.try_parse_json(options))
    listed = F.from_json(options, "array<string>")
    split = F.filter(F.transform(F.split(options, r"[\n;|]"), strip), lambda x: x != "")
    plain = F.when(F.coalesce(kind.startswith("ARRAY"), F.lit(False)), listed).otherwise(split)
    letter = lambda i: F.char(F.lit(65) + i)
    lines = F.transform(plain, lambda x, i: F.concat(letter(i), F.lit(". "), stripped_label(x)))
    return F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), options_text(options)).otherwise(F.array_join(lines, "\n"))


def image_paths(images: Column) -> Column:
    """Paths of images without their bytes, nulls dropped."""
    return F.filter(F.transform(images, lambda x: x["path"]), lambda p: p.isNotNull())


def with_bytes(images: Column) -> Column:
    return F.filter(F.coalesce(images, F.array().cast("array<struct<bytes:binary,path:string>>")), lambda x: F.coalesce(F.length(x["bytes"]) > 0, F.lit(False)))


def has_image(images: Column) -> Column:
    return F.size(with_bytes(images)) > 0


def first_images(images: Column, k: int) -> Column:
    return F.slice(images, 1, k)


def locator(tar: Column, member: Column, path: Column) -> Column:
    """``tar::member`` from its parts, else a path that has that form, else a file path; null if there is none."""
    return F.coalesce(F.when((tar != "") & (member != ""), F.concat(tar, F.lit("::"), member)), F.nullif(path, F.lit("")))


def picture_member(member: Column) -> Column:
    """Name of the picture that belongs to a JSON member."""
    return F.regexp_replace(member, r"\.json$", ".jpg")


def image_members(members: Column, paths: Column, names: Column) -> Column:
    """Sorted distinct lower-case members: given ones, else those in paths (after ``::`` or the last slash), else names."""
    clean = lambda c, f: F.array_sort(F.array_distinct(F.filter(F.transform(as_list(c), lambda x: F.lower(strip(f(x)))), lambda x: x != "")))
    inner = lambda x: F.when(F.contains(x, F.lit("::")), F.element_at(F.split(x, "::"), -1)).otherwise(F.element_at(F.split(x, "/"), -1))
    same = lambda x: x
    first, second, third = clean(members, same), clean(paths, inner), clean(names, same)
    return F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(third)


def flat_labels(labels: Column) -> Column:
    """All labels of a list of lists, stripped, blanks dropped."""
    return F.filter(F.transform(F.flatten(F.filter(labels, lambda x: x.isNotNull())), strip), lambda x: F.coalesce(x != "", F.lit(False)))


def image_tuples(ids: Column, names: Column, article: Column) -> Column:
    """(article, id, name) of a record's images; unequal lists are padded, no image is one unknown one."""
    pairs = F.transform(F.arrays_zip(as_list(ids).alias("a"), as_list(names).alias("b")), lambda z: F.struct(F.coalesce(article, F.lit("")).alias("article"), F.coalesce(z["a"], F.lit("")).alias("id"), F.coalesce(z["b"], F.lit("")).alias("name")))
    unknown = F.array(F.struct(F.coalesce(article, F.lit("")).alias("article"), F.lit("__UNKNOWN__").alias("id"), F.lit("__UNKNOWN__").alias("name")))
    return F.when(F.size(pairs) > 0, pairs).otherwise(unknown)


def coerced_bytes(raw: Column, hexed: Column, base64: Column, numbers: Column) -> Column:
    """Bytes from the first field that has any: bytes, hexadecimal (``0x`` and blanks allowed), base64, list of numbers."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(strip(hexed)), "^0x", ""), r"\s+", "")
    whole = F.forall(numbers, lambda x: x.between(0, 255)) & (F.size(numbers) > 0)
    listed = F.when(whole, F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")))
    some = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(some(raw), some(F.when(digits.rlike("^([0-9a-f]{2})+$"), F.unhex(digits))), some(F.try_to_binary(base64, F.lit("base64"))), some(listed))


def first_of(c: Column, *names: str) -> Column:
    """Text of the first of several keys of a JSON object that has one, at top level or within ``generated_vqa``."""
    paths = [f"$.{p}{n}" for n in names for p in ("", "generated_vqa.")]
    return F.coalesce(*(F.nullif(strip(F.get_json_object(c, p)), F.lit("")) for p in paths))


def mcq_fields(c: Column) -> tuple[Column, Column]:
    """(question, options) of a JSON record, under any of their names."""
    return first_of(c, "question", "stem", "prompt"), first_of(c, "options", "choices")


def mcq_signature(question: Column, options: Column) -> Column:
    """Question without case and extra blanks, and the sorted option texts likewise: equal for records that differ in
    spelling of blanks, case, and order of options."""
    key = lambda x: F.lower(strip(F.regexp_replace(x, r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+", " ")))
    texts = F.array_sort(F.transform(F.filter(F.map_values(options), lambda v: v.isNotNull()), key))
    return F.concat_ws("\n", key(question), F.array_join(texts, "|"))


def folded_signature(question: Column, options: Column) -> Column:
    """``mcq_signature`` after compatibility normalisation and case folding."""
    mark = "\x01"
    texts = F.split(folded(F.array_join(F.filter(F.map_values(options), lambda v: v.isNotNull()), mark)), mark)
    return F.concat_ws("\n", folded(question), F.array_join(F.array_sort(F.transform(texts, strip)), "|"))


def image_of_set(images: Column, key: Column) -> Column:
    """The first element of a record's image set that is the record itself."""
    return F.get(F.filter(images, lambda x: x["image_id"] == key), F.lit(0))


def packed_images(images: Column, skip_missing: bool = True) -> Column:
    """Images with bytes; others are dropped, or kept as empty places."""
    if skip_missing:
        return with_bytes(images)
    empty = F.lit(None).cast("struct<bytes:binary,path:string>")
    return F.transform(F.coalesce(images, F.array().cast("array<struct<bytes:binary,path:string>>")), lambda x: F.when(F.length(x["bytes"]) > 0, x).otherwise(empty))


def record_uid(dataset: Column, index: Column) -> Column:
    return F.concat(F.coalesce(dataset, F.lit("")), F.lit("#"), F.coalesce(index.cast("string"), F.lit("-1")))

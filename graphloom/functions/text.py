"""Scalar functions over text, identifiers and model output, as column expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = "^\\s+|\\s+$"
# File endings of images and their media types.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "bmp": "image/bmp", "gif": "image/gif", "webp": "image/webp"}
# File endings that a model's image inputs have besides.
MORE_IMAGES = ("tiff", "svg")
# Words that answers are compared without.
STOPWORDS = ("and", "or", "the", "of")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at either end; trim() takes spaces only."""
    return F.regexp_replace(_c(x), WHITE, "")


def entity_key(x: Column | str) -> Column:
    """Canonical key of an entity name."""
    return F.upper(strip(x))


def entity_keys(x: Column | str) -> Column:
    """Keys of a list of names, or of a single name: a JSON list if it parses as one."""
    names = F.coalesce(F.from_json(_c(x), "array<string>"), F.array(_c(x)))
    return F.transform(names, entity_key)


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), "([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """File name without its last ending; a name that only begins with a dot has none."""
    return F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(file_name(path), ".\\.([^.]*)$", 1))


def is_image(path: Column | str) -> Column:
    return extension(path).isin(*IMAGE_TYPES)


def is_image_url(x: Column | str) -> Column:
    """Image ending of a path, or of a URL's path without parameters, query and fragment; a name that only begins with dots has none."""
    url = F.regexp_replace(F.regexp_extract(_c(x), "^https?://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    path = F.lower(F.when(_c(x).rlike("^https?://"), url).otherwise(_c(x)))
    return path.rlike(f"(^|/)[^/]*[^/.][^/]*\\.({'|'.join([*IMAGE_TYPES, *MORE_IMAGES])})$")


def is_video(path: Column | str, frames: Column | str) -> Column:
    """Whether an input is a video: a path of any kind, or a list of frames of which the first is an image."""
    return _c(path).isNotNull() | F.coalesce((F.size(_c(frames)) > 0) & is_image_url(F.get(_c(frames), 0)), F.lit(False))


def base64(content: Column | str) -> Column:
    """In one line; Spark's own breaks it after 76 signs."""
    return F.replace(F.base64(_c(content)), F.lit("\r\n"), F.lit(""))


def media_type(path: Column | str) -> Column:
    known = F.create_map(*[F.lit(v) for kv in IMAGE_TYPES.items() for v in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("image/jpeg"))


def part_id(parent: Column | str, letter: str, index: Column | str, width: int = 3) -> Column:
    """parent:T000; longer numbers keep all digits."""
    return F.concat(_c(parent).cast("string"), F.format_string(f":{letter}%0{width}d", _c(index)))


def serial_id(letter: str, index: Column | str, width: int = 6) -> Column:
    return F.format_string(f"{letter}%0{width}d", _c(index))


def id_root(x: Column | str) -> Column:
    return F.split_part(_c(x), F.lit(":"), F.lit(1))


def id_index(x: Column | str) -> Column:
    """Number of the last part of an id."""
    return F.regexp_extract(_c(x), "([0-9]+)$", 1).cast("int")


def natural_key(x: Column | str) -> Column:
    """All runs of digits as numbers: an array, ordered item by item."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("bigint"))


def words(x: Column | str) -> Column:
    return F.filter(F.split(_c(x), "\\s+"), lambda w: w != "")


def word_count(x: Column | str) -> Column:
    return F.size(words(x))


# --- matching ---------------------------------------------------------------------------------------------------


def upper(x: Column | str) -> Column:
    """Upper case letter by letter: ß has a capital of its own instead of two letters, which "SS" in another text would equal."""
    return F.upper(F.replace(_c(x), F.lit("ß"), F.lit("ẞ")))


def has_word(text: Column | str, name: Column | str) -> Column:
    """name stands in text as whole words, whatever the case. Cheap containment is tried before the pattern."""
    t, n = F.upper(_c(text)), F.upper(_c(name))
    return F.contains(t, n) & F.regexp_like(t, F.concat(F.lit("\\b\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\b")))


def stands_alone(text: Column | str, name: Column | str) -> Column:
    """name stands in text with no letter, number or underscore next to it, whatever the case and whatever sign it ends with itself; has_word asks for a word's border there."""
    t, n = upper(text), upper(name)
    alone = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\p{L}\\p{N}_])"))
    return F.contains(t, n) & F.regexp_like(t, alone)


# Fixed values: [A-Z0-9] of plain forms and [A-Z]+ of initials.


def acronym_form(x: Column | str) -> Column:
    return F.regexp_replace(F.upper(_c(x)), "[^A-Z0-9]", "")


def initials(x: Column | str) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(F.upper(_c(x)), F.lit("[A-Z]+"), F.lit(0)), lambda w: F.left(w, F.lit(1))), "")


def is_acronym(a: Column | str, b: Column | str) -> Column:
    """Equal plain forms, or the plain form of one is the other's initials; forms of at least two characters."""
    x, y = acronym_form(a), acronym_form(b)
    return (F.length(x) >= 2) & (F.length(y) >= 2) & ((x == y) | (x == initials(b)) | (y == initials(a)))


# --- model output -----------------------------------------------------------------------------------------------


def unfenced_block(x: Column | str) -> Column:
    """What stands in the first fenced block, its language tag kept; else the text."""
    s = strip(x)
    return F.when(F.startswith(s, F.lit("```")), strip(F.split_part(s, F.lit("```"), F.lit(2)))).otherwise(s)


def unfenced(x: Column | str) -> Column:
    """Without a leading fence (with or without json) and a trailing one."""
    return strip(F.regexp_replace(F.regexp_replace(strip(x), "^```(json)?", ""), "```$", ""))


def string_list(x: Column | str) -> Column:
    """A list of strings from JSON or from a literal in single quotes; null if it isn't one."""
    return F.from_json(_c(x), "array<string>")


def string_lists(x: Column | str) -> Column:
    """A list of lists of strings; null if it isn't one."""
    return F.from_json(_c(x), "array<array<string>>")


def lenient_json(x: Column | str) -> Column:
    """The first reading that parses: the text, the fenced part, from the first [ to the last ], from the first { to the last }; as JSON text."""
    s = strip(x)
    fenced = F.substring(s, 8, 1 << 30)
    fenced = F.regexp_replace(fenced, "```$", "")
    listed, object_ = F.regexp_extract(s, "(?s)(\\[.*\\])", 1), F.regexp_extract(s, "(?s)(\\{.*\\})", 1)
    return F.coalesce(*[F.to_json(F.try_parse_json(F.when(y != "", y))) for y in (s, fenced, listed, object_)])


def nonblank_list(x: Column | str, least: int = 0, most: int | None = None) -> Column:
    """A list whose items all have text; of at least `least` and at most `most` items."""
    a = _c(x)
    ok = F.forall(a, lambda s: F.length(strip(F.coalesce(s, F.lit("")))) > 0) & (F.size(a) >= least)
    return F.coalesce(ok if most is None else ok & (F.size(a) <= most), F.lit(False))


def question_list(x: Column | str) -> Column:
    return nonblank_list(x) & F.coalesce(F.forall(_c(x), lambda s: F.endswith(strip(s), F.lit("?"))), F.lit(False))


def same_members(groups: Column | str, members: Column | str) -> Column:
    """The groups together hold the members, each at least once; twice passes."""
    return F.array_sort(F.array_distinct(F.flatten(_c(groups)))) == F.array_sort(F.array_distinct(_c(members)))


def binary_grade(x: Column | str) -> Column:
    """0 or 1, or null."""
    n = strip(x).try_cast("int")
    return F.when(n.isin(0, 1), n)


def rating(x: Column | str) -> Column:
    """The first of eight words that is 0, 1 or 2, halved."""
    known = F.filter(F.slice(words(x), 1, 8), lambda w: w.isin("0", "1", "2"))
    return F.get(known, 0).cast("double") / 2


def decomposition(x: Column | str) -> Column:
    """Units of a decomposed chunk, or null where a unit lacks one of its three parts."""
    units = F.from_json(_c(x), "array<struct<semantic_unit:string,entities:array<string>,relationships:array<string>>>")
    ok = F.forall(units, lambda u: (F.length(strip(F.coalesce(u["semantic_unit"], F.lit("")))) > 0) & (F.coalesce(F.size(u["entities"]), F.lit(0)) > 0) & (F.coalesce(F.size(u["relationships"]), F.lit(0)) > 0))
    return F.when((F.size(units) > 0) & ok, units)


# --- answers ----------------------------------------------------------------------------------------------------


# Letters that Unicode doesn't take apart, with their Latin spelling.
SPELLED = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ſ": "s",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ї": "yi", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t",
    "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}


@lru_cache(maxsize=1)
def _latin() -> tuple[str, str, dict[str, str]]:
    """Letters and what they become, one for one; and those that become several letters or none. Accented letters by Unicode's own decomposition."""
    table = dict(SPELLED)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c.islower() and c not in table and base != c:
            plain = "".join(SPELLED.get(x, x) for x in base)
            if plain.isascii():
                table[c] = plain
    marks = "".join(map(chr, range(0x300, 0x370)))
    one = [(c, x) for c, x in table.items() if len(x) == 1]
    gone = "".join(c for c, x in table.items() if not x) + marks
    return "".join(c for c, _ in one) + gone, "".join(x for _, x in one), {c: x for c, x in table.items() if len(x) > 1}


def in_latin(x: Column | str) -> Column:
    """Lower-case text in ASCII as far as it is Latin, Greek or Cyrillic: accents dropped, other letters spelled out."""
    source, target, several = _latin()
    out = F.translate(F.lower(_c(x)), source, target)
    for c, y in several.items():
        out = F.replace(out, F.lit(c), F.lit(y))
    return out


def plain_answer(x: Column | str) -> Column:
    """Lower case, in Latin letters, hyphens as spaces, letters and digits only, single spaces, no stopwords."""
    kept = F.regexp_replace(F.replace(in_latin(x), F.lit("-"), F.lit(" ")), "[^a-z0-9\\s]", "")
    return F.array_join(F.filter(words(kept), lambda w: ~w.isin(*STOPWORDS)), " ")


def contained_score(answer: Column | str, gold: Column | str) -> Column:
    """100 where one contains the other, raw or plain; else null (the ratios decide)."""
    a, g = _c(answer), _c(gold)
    p, q = plain_answer(a), plain_answer(g)
    return F.when(F.contains(a, g) | F.contains(g, a) | F.contains(p, q) | F.contains(q, p), F.lit(100.0))


def numbers(x: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_c(x), F.lit("-?[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), lambda s: s.cast("double"))


def number_score(answer: Column | str, value: Column, low: Column, high: Column) -> Column:
    """The first number that equals the value gives 100, or lies outside the range gives 0; if all lie inside 100; without numbers 0."""
    found = numbers(answer)
    first = F.get(F.filter(found, lambda n: (n == value) | (n < low) | (n > high)), 0)
    return F.when(F.size(found) == 0, 0).when(first.isNull() | (first == value), 100).otherwise(0).cast("double")


ANSWER = "struct<text:string,number:double,value:string,low:string,high:string>"


def reference_answers(x: Column | str) -> Column:
    """A JSON list of acceptable answers as an array of ANSWER: a text, a number, or an exact value (key wikidata) with the range around it. Anything else fails."""
    items = F.try_variant_get(F.try_parse_json(_c(x)), "$", "array<variant>")

    def item(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        of = lambda path, t="string": F.try_variant_get(v, path, t)
        none = F.lit(None).cast("string")
        last = F.coalesce(of("$.range[1]"), of("$.range[0]"))
        made = lambda text, number, value, low, high: F.struct(text.alias("text"), number.cast("double").alias("number"), value.alias("value"), low.alias("low"), high.alias("high"))
        ranged = F.startswith(kind, F.lit("OBJECT")) & of("$.wikidata").isNotNull() & F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.range", "variant")), F.lit("ARRAY"))
        return (
            F.when(kind == "STRING", made(of("$"), none, none, none, none))
            .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), made(none, of("$", "double"), none, none, none))
            .when(ranged, made(none, none, of("$.wikidata"), of("$.range[0]"), last))
            .otherwise(F.raise_error(F.lit("neither a text nor a number nor a value with its range")).cast(ANSWER))
        )

    return F.when(items.isNull(), F.raise_error(F.lit("acceptable answers are not a list")).cast(f"array<{ANSWER}>")).otherwise(F.transform(items, item))


def acceptable(answers: Column | str) -> Column:
    """The sentences that say which answers (an array of ANSWER) are acceptable; plain numbers say nothing."""
    # The wording of the sentences.
    said = lambda a: F.when(a["text"].isNotNull(), F.concat(F.lit("An acceptable answer is: "), a["text"], F.lit("."))).when(
        a["value"].isNotNull(), F.concat(F.lit("The exact answer is "), a["value"], F.lit(". Any answer lying in the range from "), a["low"], F.lit(" to "), a["high"], F.lit(" is acceptable."))
    )
    return F.array_join(F.transform(_c(answers), said), "\n")


def escaped_json(x: Column | str) -> Column:
    """JSON text in ASCII alone: all other code points as escapes of their UTF-16 units."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1")
    return F.array_join(F.transform(F.regexp_extract_all(_c(x), F.lit("(?s)."), F.lit(0)), lambda c: F.when(F.ascii(c) < 128, c).otherwise(units(c))), "")


def with_full_stop(x: Column | str) -> Column:
    """Ends in punctuation: a full stop is added where it doesn't."""
    s = strip(x)
    return F.when((s == "") | s.rlike("\\p{P}$"), s).otherwise(F.concat(s, F.lit(".")))


def numbered(items: Column | str) -> Column:
    """[1] first, [2] second: one a line."""
    return F.array_join(F.transform(_c(items), lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n")


# --- messages for models ----------------------------------------------------------------------------------------

PART = "struct<type:string,text:string,url:string>"


def text_part(x: Column | str) -> Column:
    return F.struct(F.lit("text").alias("type"), _c(x).alias("text"), F.lit(None).cast("string").alias("url"))


def image_part(x: Column | str) -> Column:
    return F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), _c(x).alias("url"))


def video_part(x: Column | str) -> Column:
    return F.struct(F.lit("video").alias("type"), F.lit(None).cast("string").alias("text"), _c(x).alias("url"))


def embedding_message(instruction: Column | str, text: Column | str, image: Column | str, video: Column | str) -> Column:
    """System instruction, then video, image and text where given; a part NULL where none is."""
    parts = F.array_compact(F.array(F.when(_c(video).isNotNull(), video_part(video)), F.when(_c(image).isNotNull(), image_part(image)), F.when(F.length(_c(text)) > 0, text_part(text))))
    return F.concat(F.array(text_part(with_full_stop(instruction))), F.when(F.size(parts) > 0, parts).otherwise(F.array(text_part(F.lit("NULL")))))


def context_messages(contexts: Column | str, question: Column | str, image: Column | str, least: float = 0.5) -> Column:
    """What a model is given: of the contexts (array of rank, score, type, content, names) those that score `least` at least, each under its place among all, images with their names; then the question, its image and the question again."""
    one = lambda c: F.when(
        c["score"] >= least,
        F.concat(
            F.array(text_part(F.concat(F.lit("---Context "), c["rank"].cast("string"), F.lit("---")))),
            F.when(c["type"] == "V", F.array(text_part(F.concat(F.lit("This is an image of: "), F.coalesce(c["names"], F.lit("")))), image_part(c["content"]))).otherwise(F.array(text_part(c["content"]))),
        ),
    ).otherwise(F.array().cast(f"array<{PART}>"))
    asked = text_part(F.concat(F.lit("[QUESTION]\n"), _c(question)))
    parts = F.flatten(F.transform(F.array_sort(_c(contexts)), one))
    return F.concat(F.array(text_part(F.lit("[CONTEXT]"))), parts, F.array(asked, text_part(F.lit("[QUESTION IMAGE]")), image_part(image), asked))


def message_text(parts: Column | str) -> Column:
    """A message in one line, each part by its type and what it holds; for comparison."""
    return F.array_join(F.transform(_c(parts), lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], p["url"]))), "|")


# The tags of a reranker's message.
def rerank_message(instruction: Column | str, query: Column | str, document: Column | str) -> Column:
    tag = lambda t: text_part(F.lit(t))
    return F.array(text_part(F.concat(F.lit("<Instruct>: "), _c(instruction))), tag("<Query>:"), text_part(query), tag("<Document>:"), text_part(document))


def even_frames(frames: Column | str, n: int) -> Column:
    """n frames spread evenly from the first to the last."""
    f = _c(frames)
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.size(f) - 1) / max(1, n - 1)).cast("int"))
    return F.when(F.size(f) <= n, f).otherwise(F.transform(at, lambda i: F.get(f, i)))


def truncated_tokens(tokens: Column | str, special: Column | str, most: int) -> Column:
    """At most `most` tokens: all special ones, and of the others the first that fit."""
    t, s = _c(tokens), _c(special)
    room = F.lit(most) - F.size(F.filter(t, lambda x: F.array_contains(s, x)))
    kept = F.transform(t, lambda x, i: F.struct(x.alias("x"), (F.array_contains(s, x) | (F.size(F.filter(F.slice(t, 1, i + 1), lambda y: ~F.array_contains(s, y))) <= room)).alias("k")))
    return F.transform(F.filter(kept, lambda p: p["k"]), lambda p: p["x"])

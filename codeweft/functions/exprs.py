"""Column expressions over names, paths and texts of code entities. Null counts as empty unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeweft.functions import vocab as V


SPACE = " \t\n\r\f\v"
#: All white space of Unicode, which surrounds names.
BLANK = SPACE + "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def bound(c: Column, f) -> Column:
    """f of a value that is computed once: in a higher-order function an expression would be evaluated per element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bare(label: Column) -> Column:
    """Name without surrounding white space, leading dots and trailing parentheses."""
    return F.rtrim(F.ltrim(F.btrim(text(label), F.lit(BLANK)), F.lit(".")), F.lit("()"))


def norm(label: Column) -> Column:
    return F.lower(bare(label))


def basename(path: Column) -> Column:
    return F.substring_index(text(path), "/", -1)


def extension(path: Column) -> Column:
    base = F.lower(basename(path))
    return F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise("")


def segments(path: Column) -> Column:
    return F.split(F.lower(text(path)), "/")


def _any(conditions) -> Column:
    return reduce(or_, conditions)


def is_generic(label: Column) -> Column:
    """Types, type parameters, primitives; a missing label is generic too."""
    raw = F.btrim(text(label), F.lit(BLANK))
    parameter = raw.rlike(r"^\p{Lu}\p{L}?$")
    return (raw == "") | F.rtrim(F.lower(raw), F.lit("()")).isin(*V.GENERIC) | parameter


def is_noise(label: Column) -> Column:
    return is_generic(label) | norm(label).isin(*V.FRAMEWORK)


def is_test_path(path: Column) -> Column:
    s = F.lower(text(path))
    part = F.exists(segments(path), lambda p: p.isin("tests", "test") | p.endswith("-tests") | p.endswith("-test") | p.endswith(".tests"))
    return s.contains(".test.") | s.contains(".spec.") | s.endswith("tests.cs") | s.endswith("test.cs") | part


def relation_kind(relation: Column) -> Column:
    return F.when(F.lower(text(relation)).isin(*V.STRUCTURAL), "structural").otherwise("inferred")


def layer_of(path: Column) -> Column:
    e, parts = extension(path), segments(path)
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return F.when(e.isin(*V.BACK_EXT), "backend").when(e.isin(*V.FRONT_EXT), "frontend").when(has(V.BACK_DIRS), "backend").when(has(V.FRONT_DIRS), "frontend")


def kind_matches(path: Column, file_type: Column, kind: str) -> Column:
    """kind: all, code, tests, docs, prod, frontend or backend; any other matches all."""
    test, ft = is_test_path(path), text(file_type)
    code = (ft == "code") & ~test
    if kind == "tests":
        return test
    if kind == "docs":
        return ft.isin(*V.DOC_TYPES)
    if kind == "code":
        return code
    if kind in ("frontend", "backend"):
        return code & F.coalesce(layer_of(path) == kind, F.lit(False))
    if kind == "prod":
        return code & ~F.lower(text(path)).contains(".generated.") & ~F.arrays_overlap(segments(path), F.array(*map(F.lit, V.NONPROD_DIRS)))
    return F.lit(True)


def is_symbol(label: Column, path: Column) -> Column:
    low, s = F.lower(text(label)), F.lower(text(path))
    return (text(label) != "") & ~_any(s.endswith(e) for e in V.NONSOURCE_EXT) & ~_any(low.endswith("." + e) for e in V.FRONT_EXT + V.BACK_EXT)


def is_interface_member(label: Column, path: Column) -> Column:
    named = lambda c: c.rlike(r"^I\p{Lu}")
    return named(basename(path)) | F.lower(text(path)).contains("/interfaces/") | named(bare(label))


def is_family_pair(a: Column, b: Column) -> Column:
    x, y = bare(a), bare(b)
    longer, shorter = F.when(F.length(x) >= F.length(y), x).otherwise(y), F.when(F.length(x) >= F.length(y), y).otherwise(x)
    return (x != "") & (y != "") & longer.startswith(shorter) & F.substr(longer, F.length(shorter) + 1).isin(*V.FAMILY)


def impact_category(label: Column, path: Column, file_type: Column) -> Column:
    s, ft = text(path), text(file_type)
    front = s.startswith("frontend/") | _any(s.endswith(e) for e in (".ts", ".tsx", ".vue", ".jsx"))
    contract = text(label).rlike(V.CONTRACT) | s.rlike(V.CONTRACT)
    return F.when(is_test_path(path), "tests").when(front, "frontend").when(ft.isin(*V.DOC_TYPES), "docs").when(contract, "contract").when(ft == "code", "backend").otherwise("other")


def is_fragment(path: Column, location: Column, relations: Column) -> Column:
    """A stub (neither file nor location) or a node whose edges only consume."""
    rels = F.coalesce(relations, F.array().cast("array<string>"))
    only = F.size(F.array_except(rels, F.array(*map(F.lit, V.REF_ONLY)))) == 0
    return ((text(path) == "") & (text(location) == "")) | ((F.size(rels) > 0) & only)


def conventions(label: Column) -> Column:
    """Names that belong to a name by convention, in order: array of relation and target."""
    b = bare(label)
    pair = lambda rel, target: F.struct(F.lit(rel).alias("relation"), target.alias("target"))
    interface = b.rlike(r"^I\p{Lu}")
    found = F.array(
        pair("tested_by", F.concat(b, F.lit("Tests"))),
        pair("tested_by", F.concat(b, F.lit("Test"))),
        F.when(b.endswith("Command") | b.endswith("Query"), pair("handled_by", F.concat(b, F.lit("Handler")))),
        F.when(b.endswith("Handler"), pair("handles", F.regexp_replace(b, "Handler$", ""))),
        pair("impl_of", F.when(interface, F.substr(b, F.lit(2))).otherwise(F.concat(F.lit("I"), b))),
    )
    return F.when(b != "", F.filter(found, lambda x: x.isNotNull())).otherwise(F.filter(found, lambda x: F.lit(False)))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def text_hash(model: Column, c: Column) -> Column:
    return F.sha1(F.concat(model, F.lit("\0"), c))


def sanitize(name: Column) -> Column:
    """A graph's name from a path's name."""
    out = F.btrim(F.regexp_replace(F.regexp_replace(text(name), r"[^A-Za-z0-9_]", "_"), "_+", "_"), F.lit("_"))
    return F.when(out == "", "graph").otherwise(out)


def line_numbers(location: Column) -> Column:
    """start and end of a location such as L18 or L18-L30; null where missing."""
    n = F.regexp_extract_all(text(location), F.lit(r"(\d+)"), F.lit(1))
    return F.struct(F.get(n, F.lit(0)).cast("int").alias("start"), F.get(n, F.lit(1)).cast("int").alias("end"))


def snippet(lines: Column, location: Column, window: int = 12, most: int = 500) -> Column:
    """The lines of a location (window lines without an end), trimmed and cut."""
    at = line_numbers(location)
    begin = F.greatest(at["start"] - 1, F.lit(0))
    end = F.greatest(F.least(F.size(lines), F.coalesce(at["end"], begin + window)), begin + 1)
    return F.when(at["start"].isNull() | (begin >= F.size(lines)), "").otherwise(F.substring(F.btrim(F.array_join(F.slice(lines, begin + 1, end - begin), "\n"), F.lit(SPACE)), 1, most))


def node_text(*parts: Column) -> Column:
    """Non-empty parts joined by bars."""
    return F.array_join(F.filter(F.array(*[text(p) for p in parts]), lambda x: x != ""), " | ")


def _code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[^\sA-Za-z0-9_])"), F.lit(1))


def shingle_hashes(c: Column, k: int = 4) -> Column:
    """The 64-bit hashes of shingles(), made without their texts."""

    def grams(t: Column) -> Column:
        n = F.size(t)
        every = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)]))
        return F.when(n >= k, F.array_distinct(every)).when(n > 0, F.array(F.xxhash64(F.array_join(t, " ")))).otherwise(F.array().cast("array<bigint>"))

    return bound(_code_tokens(c), grams)


def shingles(c: Column, k: int = 4) -> Column:
    """Distinct k-grams of identifiers and single signs; fewer tokens make one, none makes none."""
    tokens = _code_tokens(c)

    def grams(t: Column) -> Column:
        n = F.size(t)
        every = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(t, i + 1, F.lit(k)), " "))
        return F.when(n >= k, F.array_distinct(every)).when(n > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))

    return bound(tokens, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(bound(shared, lambda m: m / (F.size(a) + F.size(b) - m)))


def text_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts by shingles, which are made once for each."""
    return bound(F.struct(shingle_hashes(a).alias("a"), shingle_hashes(b).alias("b")), lambda x: jaccard(x["a"], x["b"]))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 for equal directions, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def lexical_tokens(c: Column) -> Column:
    """Distinct lower-cased words of three letters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit(r"((?U)\w+)"), F.lit(1)), lambda w: F.length(w) >= 3))


# Text around a declaration. lines: array of a file's lines; null where the file can't be read ----------------------


def split_lines(c: Column) -> Column:
    """Lines of a text; an ending break makes no further line."""
    parts = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


# fixed values
_COMMENT = r"^(//|/\*|\*|#)"
_MARKERS = r"^\s*(///?|/\*\*?|\*/?|#)+|\*/\s*$"
_ATTRIBUTES = ("placeholder", "title", "label", "aria-label", "alt", "tooltip", "heading", "header", "caption", "subtitle", "description")
_CODE_WORDS = ("import", "export", "const", "return", "function")
_CODE_SIGNS = r"[=;(){}\[\]<>]|&&|\|\|"


def leading_comment(lines: Column, location: Column, scan: int = 15, most: int = 300) -> Column:
    """The comment above a declaration: of the lines above it up to the first of code, those that are comments, without
    markers, tags and rules. Blank lines, attributes and decorators may stand between."""
    start = line_numbers(location)["start"]

    def told(start: Column) -> Column:
        from_ = F.greatest(start - 1 - scan, F.lit(0))
        above = F.transform(F.reverse(F.slice(lines, from_ + 1, F.greatest(F.least(start - 1, F.size(lines)) - from_, F.lit(0)))), lambda s: F.btrim(s, F.lit(SPACE)))
        comment = lambda s: ~s.rlike(r"^[\[@]") & (s.rlike(_COMMENT) | s.endswith("*/"))
        passed = lambda s: (s == "") | s.rlike(r"^[\[@]") | s.isin("]", ")", "{") | comment(s)
        stop = lambda a: F.array_position(F.transform(a, lambda s: ~passed(s)), True)
        block = bound(above, lambda a: F.when(stop(a) > 0, F.slice(a, 1, F.greatest(stop(a).cast("int") - 1, F.lit(0)))).otherwise(a))
        plain = lambda s: F.regexp_replace(F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _MARKERS, ""), r"</?[a-zA-Z][^>]*>", " "), r"\s+", " ")), r"^[\-=*_~\s]+|[\-=*_~\s]+$", "")
        return F.substring(F.array_join(F.filter(F.transform(F.reverse(F.filter(block, comment)), plain), lambda s: F.length(s) >= 3), " "), 1, most)

    known = start.isNotNull() & lines.isNotNull() & (start <= F.size(lines) + 1)
    return F.when(known, bound(start, told)).otherwise("")


def _is_copy(s: Column) -> Column:
    """A literal that reads like words on a screen, not like a class, path, key or name."""
    spaced = s.contains(" ")
    css = F.forall(F.split(s, r"\s+"), lambda t: t.rlike(r"^[!a-z0-9][a-z0-9:.\-/!]*$"))
    return F.length(s).between(3, 60) & s.rlike(r"\p{L}") & ~s.rlike(r"^[.@#$%&]") & ~s.rlike(r"[/\\_]") & ~s.rlike(_CODE_SIGNS) & ~css & (spaced | ~s.rlike(r"[.:]|^[A-Za-z][A-Za-z0-9]*$"))


def _is_markup_text(s: Column) -> Column:
    name = ~s.rlike("[А-Яа-яЁё]") & s.rlike(r"[a-z][A-Z]|[A-Z]{3,}")
    return F.length(s).between(2, 60) & s.rlike(r"\p{L}") & ~s.rlike(_CODE_SIGNS) & ~F.substring_index(s, " ", 1).isin(*_CODE_WORDS) & (s.contains(" ") | ~(s.rlike(r"[.:_/]") | name))


def ui_text(path: Column, lines: Column, location: Column, span: int = 80, most: int = 240) -> Column:
    """What a frontend declaration shows on screen: texts between tags, some attributes, literals; each once in any case.
    Texts are added while fewer than `most` characters were."""
    at = line_numbers(location)
    begin = F.greatest(at["start"] - 1, F.lit(0))
    end = F.least(F.size(lines), F.coalesce(at["end"], at["start"] + span))
    body = F.array_join(F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0))), "\n")

    def shown(body: Column) -> Column:
        found = lambda pattern: F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda s: F.btrim(s, F.lit(SPACE)))
        markup = F.filter(found(r">\s*([^<>{}\n][^<>{}\n]*?)\s*<"), _is_markup_text)
        attributes = found(r"(?i)\b(?:" + "|".join(_ATTRIBUTES) + r""")\s*=\s*["']([^"'\n{}]{2,60})["']""")
        literals = F.filter(found(r"""["']([^"'\n]{3,60})["']"""), _is_copy)
        empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("total"))

        def add(state: Column, s: Column) -> Column:
            new = (s != "") & (state["total"] < most) & ~F.array_contains(state["seen"], F.lower(s))
            return F.when(new, F.struct(F.array_append(state["out"], s).alias("out"), F.array_append(state["seen"], F.lower(s)).alias("seen"), (state["total"] + F.length(s)).alias("total"))).otherwise(state)

        return F.aggregate(F.concat(markup, attributes, literals), empty, add, lambda state: F.array_join(state["out"], " | "))

    wanted = F.coalesce(layer_of(path) == "frontend", F.lit(False)) & ~is_test_path(path) & at["start"].isNotNull() & lines.isNotNull()
    return F.when(wanted, bound(body, shown)).otherwise("")


def entity_text(label: Column, path: Column, location: Column, lines: Column, file_type: Column, community: Column | None = None) -> Column:
    """What is indexed for an entity: name, body, comment, screen texts, path, community, type. The text to embed leaves
    the community out, so that the cache's keys outlast a new clustering."""
    known = text(path) != ""
    body = F.when(known & lines.isNotNull() & (F.size(lines) > 0), snippet(lines, location)).otherwise("")
    comment = F.when(known, leading_comment(lines, location)).otherwise("")
    parts = [label, body, comment, ui_text(path, lines, location), F.translate(text(path), "/.", "  ")]
    return strip_control(node_text(*parts, *([community] if community is not None else []), file_type))

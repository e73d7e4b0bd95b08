"""The text functions under names for Spark SQL, and a table function of the citations of a body.

The functions are SQL functions, so Spark puts their bodies into the plan of the query that calls them: no Python worker takes part, and filters and
columns are pushed through them. ``register`` puts all down as temporary functions of a session. The citations of a column of bodies are

    select note, r.* from (select note, note_refs(body) as refs from notes) n, lateral inline(n.refs) r

A SQL table function in its place would be planned as a join on the bodies themselves; refs(note, body) is a Python one, without a join.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from notelake.functions.text import CODE, MAX_SLUG, SLUG, SOURCE_EXTENSIONS, STOPWORDS, SYMBOL, TRANSLITERATION, WIKILINK
from notelake.session import ship


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(map(_quoted, values)) + ")"


def _slug() -> str:
    single = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
    text = f"translate(note_lower(title), {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for k, v in TRANSLITERATION.items():
        if len(v) > 1:
            text = f"replace({text}, {_quoted(k)}, {_quoted(v)})"
    return f"btrim(regexp_replace({text}, '[^a-z0-9]+', '-'), '-')"


_CUT = f"substring(whole, 1, {MAX_SLUG})"
FUNCTIONS = {
    "note_lower(body string) returns string": "translate(lower(translate(body, 'İ', 'i')), 'ς', 'σ')",
    "note_tokens(body string) returns array<string>": r"filter(split(note_lower(body), '[^\\p{L}\\p{Nd}]+'), t -> octet_length(t) > 1)",
    "note_terms(body string) returns array<string>": f"sort_array(array_distinct(array_except(note_tokens(body), {_array(STOPWORDS)})))",
    "note_whole_slug(title string) returns string": _slug(),
    "note_cut_slug(whole string) returns string": f"case when length(whole) > {MAX_SLUG} then btrim(case when locate('-', {_CUT}) > 1 then regexp_replace({_CUT}, '-[^-]*$', '') else {_CUT} end, '-') else whole end",
    "note_slug(title string) returns string": "note_cut_slug(note_whole_slug(title))",
    "note_is_slug(value string) returns boolean": f"value rlike {_quoted(SLUG)}",
    "note_strip_code(body string) returns string": f"regexp_replace(body, {_quoted(CODE)}, ' ')",
    "note_wikilinks(body string) returns array<string>": rf"filter(transform(regexp_extract_all(note_strip_code(body), {_quoted(WIKILINK)}, 1), t -> btrim(t, ' \t\n\u000b\f\r')), t -> t <> '')",
    "note_link_key(target string) returns string": r"lower(btrim(regexp_replace(trim(regexp_replace(target, '^\\./', '')), '\\.md$', ''), '/'))",
    "note_short_hash(body string, n int) returns string": "substring(sha2(body, 256), 1, n)",
}
_LINE, _NAME = r"'(?::|#L)(\\d{1,6})$'", _quoted(SYMBOL)
_BARE = rf"regexp_replace(s, {_LINE}, '')"
_IS_PATH = rf"lower(regexp_extract({_BARE}, '(\\.[^.]*)$', 1)) in ({', '.join(map(_quoted, SOURCE_EXTENSIONS))})"
_OWNER, _MEMBER = (f"regexp_extract({_BARE}, {_NAME}, {k})" for k in (1, 2))
#: The citation of a span ``s``, or null.
_SPAN = rf"""case when s = '' or s rlike '[ \\t"\'|$<>*?]' then null
    when {_IS_PATH} then named_struct('raw', s, 'kind', 'path', 'path', translate({_BARE}, '\\', '/'), 'symbol', '', 'line', coalesce(cast(nullif(regexp_extract(s, {_LINE}, 1), '') as int), 0))
    when not contains({_BARE}, '/') and {_OWNER} <> '' then named_struct('raw', s, 'kind', 'symbol', 'path', '', 'symbol', concat_ws('.', {_OWNER}, nullif({_MEMBER}, '')), 'line', 0) end"""
_REF = "struct<raw string, kind string, path string, symbol string, line int>"
FUNCTIONS[f"note_refs(body string) returns array<{_REF}>"] = rf"filter(transform(array_distinct(transform(regexp_extract_all(body, '`([^`\n]{{1,200}})`', 1), s -> trim(s))), s -> {_SPAN}), r -> r is not null)"


class Refs:
    """refs(note, body): the rows of note_refs, for callers who want a table function. ``lateral inline`` over note_refs needs no Python."""

    _SPANS, _BAD = re.compile(r"`([^`\n]{1,200})`"), re.compile("[ \t\"'|$<>*?]")
    _AT, _SYMBOL = re.compile(r"(?::|#L)([0-9]{1,6})$"), re.compile(SYMBOL)

    def eval(self, note: str, body: str):
        found = dict.fromkeys(s.strip(" ") for s in self._SPANS.findall(body or ""))
        at = 0
        for s in found:
            line, bare = self._AT.search(s), self._AT.sub("", s)
            if s == "" or self._BAD.search(s):
                continue
            if "." in bare and bare[bare.rindex(".") :].lower() in SOURCE_EXTENSIONS:
                yield note, at, s, "path", bare.replace("\\", "/"), "", int(line[1]) if line else 0
            elif "/" not in bare and (m := self._SYMBOL.match(bare)):
                yield note, at, s, "symbol", "", ".".join(filter(None, m.groups())), 0
            else:
                continue
            at += 1


def register(spark: SparkSession) -> None:
    """note_tokens, note_terms, note_slug and the others of FUNCTIONS, and the table function refs(note, body)."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    ship(spark)
    spark.udtf.register("refs", F.udtf(Refs, returnType="note string, at int, raw string, kind string, path string, symbol string, line int"))

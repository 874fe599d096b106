"""YAML and TOML subsets to and from JSON, as column expressions over whole files.

Reading is complete: the subsets are line-based and flat. Writing covers flat JSON objects; nested ones are written by
``fileloom.operators.tree``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fileloom.functions.tabular import json_quote, let, lines, number_text
from fileloom.functions.text import trim, trim_start


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def yaml_scalar(s: Column) -> Column:
    """A trimmed value as JSON: null, booleans, integers, finite floats, else a string without its quotes."""
    return let(s, _yaml_scalar)


def _yaml_scalar(s: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(s, '^"+|"+\\z', ""), "^'+|'+\\z", "")
    # what reads as a float that is not finite keeps its text
    endless = s.rlike(r"^(?i)[+-]?(inf|infinity|nan)$") | s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(s.isin("", "null", "~"), "null").when(s.isin("true", "false"), s).otherwise(F.coalesce(number_text(s), json_quote(F.when(endless, s).otherwise(bare))))


def toml_scalar(s: Column) -> Column:
    """A trimmed value as JSON; null for a single quote character, which cannot be read."""
    return let(s, _toml_scalar)


def _toml_scalar(s: Column) -> Column:
    quoted = (F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))) | (F.startswith(s, F.lit("'")) & F.endswith(s, F.lit("'")))
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    return F.when(quoted & (F.length(s) == 1), F.lit(None)).when(quoted, json_quote(inner)).when(s.isin("true", "false"), s).otherwise(F.coalesce(number_text(s), json_quote(s)))


def _last_of_each(entries: Column) -> Column:
    """Of structs (key, pos, ...) the last of each key, in order of keys."""
    last = lambda e: F.filter(e, lambda x, i: (i == F.size(e) - 1) | (F.get(e, i + 1)["key"] != x["key"]))
    return let(F.array_sort(entries), last)


def _object(members: Column, indent: int) -> Column:
    """Texts of members as a pretty object at a depth of indent."""
    pad = "  " * indent
    inner = lambda x: F.array_join(F.transform(x, lambda m: F.concat(F.lit(f"{pad}  "), m)), ",\n")
    return let(members, lambda x: F.when(F.size(x) == 0, "{}").otherwise(F.concat(F.lit("{\n"), inner(x), F.lit(f"\n{pad}}}"))))


def yaml_to_json(text: Column | str) -> Column:
    """Every line with a colon is a member, whatever its indentation; the last of a key counts."""
    kept = F.filter(F.transform(lines(text), trim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & (x != "---") & (F.instr(x, ":") > 0))
    entries = F.transform(kept, lambda x, i: F.struct(trim(F.substring_index(x, ":", 1)).alias("key"), i.alias("pos"), yaml_scalar(trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("value")))
    return _object(F.transform(_last_of_each(entries), lambda e: F.concat(json_quote(e["key"]), F.lit(": "), e["value"])), 0)


#: Stand between the parts of a document under way; JSON texts hold neither.
_SECTION, _NAME = "\x01", "\x02"


def toml_to_json(text: Column | str) -> Column:
    """struct(output, error): members before the first [section] are the root's, others their section's.

    Lines are split into sections, members sorted, and sections cut out of the joined result, so that no member looks
    through the others: the work grows with the file (its sorting apart).
    """
    kept = F.filter(F.transform(lines(text), trim), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    # the first piece is the root's, as every other begins with its [section]
    pieces = F.split(F.concat(F.lit("\n"), F.array_join(kept, "\n")), r"\n(?=\[[^\n]*\](?:\n|\z))", -1)

    def members(piece: Column, i: Column) -> Column:
        own = F.split(piece, "\n", -1)
        name = F.when(i > 0, trim(F.substring(F.get(own, F.lit(0)), F.lit(2), F.length(F.get(own, F.lit(0))) - 2)))

        def member(line: Column, k: Column) -> Column:
            value = toml_scalar(trim(F.substring(line, F.instr(line, "=") + 1, F.length(line))))
            return F.struct(name.alias("section"), trim(F.substring_index(line, "=", 1)).alias("key"), i.alias("piece"), k.alias("pos"), value.alias("value"))

        # the head of a section is no member, whatever it holds
        return F.filter(F.transform(own, lambda x, k: F.when((F.instr(x, "=") > 0) & ((k > 0) | (i == 0)), member(x, k))), lambda m: m.isNotNull())

    shown = lambda e: F.concat(json_quote(e["key"]), F.lit(": "), e["value"])

    def last(found: Column) -> Column:
        """Of the members of a section with the same key the last, in order of sections and keys."""
        same = lambda x, y: x["section"].eqNullSafe(y["section"]) & (x["key"] == y["key"])
        return let(F.array_sort(found), lambda e: F.filter(e, lambda x, i: (i == F.size(e) - 1) | ~same(x, F.get(e, i + 1))))

    def tables(e: Column) -> Column:
        """e: members in order of sections. (key, kind, text) of each section, by joining all of them and cutting between."""

        def part(x: Column, i: Column) -> Column:
            opens = (i == 0) | (F.get(e, i - 1)["section"] != x["section"])
            return F.concat(F.when(opens, F.concat(F.lit(_SECTION), json_quote(x["section"]), F.lit(_NAME))).otherwise(",\n"), F.lit("    "), shown(x))

        joined = F.split(F.array_join(F.transform(e, part), ""), _SECTION, -1)
        names = F.transform(F.filter(e, lambda x, i: (i == 0) | (F.get(e, i - 1)["section"] != x["section"])), lambda x: x["section"])
        texts = F.filter(joined, lambda x: x != "")
        return F.zip_with(names, texts, lambda n, t: F.struct(n.alias("key"), F.lit(1).alias("kind"), F.concat(F.substring_index(t, _NAME, 1), F.lit(": {\n"), F.substring(t, F.instr(t, _NAME) + 1, F.length(t)), F.lit("\n  }")).alias("text")))

    def written(e: Column) -> Column:
        root = F.transform(F.filter(e, lambda x: x["section"].isNull()), lambda x: F.struct(x["key"].alias("key"), F.lit(0).alias("kind"), shown(x).alias("text")))
        below = let(F.filter(e, lambda x: x["section"].isNotNull()), tables)
        # a section that is named like one of the root's members keeps none of its own
        every = let(F.array_sort(F.concat(root, below)), lambda x: F.filter(x, lambda m, i: (i == 0) | (F.get(x, i - 1)["key"] != m["key"])))
        return F.struct(_object(F.transform(every, lambda m: m["text"]), 0).alias("output"), F.lit(None).cast("string").alias("error"))

    def checked(found: Column) -> Column:
        bad = F.exists(found, lambda x: x["value"].isNull())
        failed = F.struct(F.lit(None).cast("string").alias("output"), F.lit("TOML parse error: a value is a single quote character").alias("error"))
        return F.when(bad, failed).otherwise(let(last(found), written))

    return let(F.flatten(F.transform(pieces, members)), checked)


def _members(text: Column | str) -> Column:
    """(key, kind of variant, value as text) of a flat object, in order of keys."""
    pairs = F.struct(F.from_json(_c(text), "map<string,string>").alias("texts"), F.try_variant_get(F.try_parse_json(_c(text)), "$", "map<string,variant>").alias("kinds"))
    entry = lambda p, k: F.struct(k.alias("key"), F.schema_of_variant(F.element_at(p["kinds"], k)).alias("kind"), F.element_at(p["texts"], k).alias("value"))
    return let(pairs, lambda p: F.transform(F.array_sort(F.map_keys(p["texts"])), lambda k: entry(p, k)))


def _plain(m: Column) -> Column:
    """A member's value without quotes; numbers as JSON writes them."""
    number = ~m["kind"].isin("STRING", "VOID", "BOOLEAN")
    return F.when(number, F.coalesce(number_text(m["value"]), m["value"])).otherwise(F.coalesce(m["value"], F.lit("null")))


def flat_json_to_yaml(text: Column | str) -> Column:
    """key: value lines of a flat object; values stand without quotes, an empty one swallows its line end."""
    return F.array_join(F.transform(_members(text), lambda m: F.concat(m["key"], F.lit(": "), trim_start(F.concat(_plain(m), F.lit("\n"))))), "")


def flat_json_to_toml(text: Column | str) -> Column:
    """key = value lines of a flat object; strings are quoted whatever they look like, null is an empty string."""
    value = lambda m: F.when(m["kind"] == "VOID", '""').when(m["kind"] == "STRING", F.concat(F.lit('"'), m["value"], F.lit('"'))).otherwise(_plain(m))
    return F.array_join(F.transform(_members(text), lambda m: F.concat(m["key"], F.lit(" = "), value(m), F.lit("\n"))), "")

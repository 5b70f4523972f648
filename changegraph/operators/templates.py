"""String expressions of source code as templates of literals and unknowns.

An expression (``BASE + "/owners/" + id``, a template literal, ``environment.api``) is cut once into
parts: literals, names and unknowns. Names, each once for all expressions that name it from the same
place, are then replaced by the parts of the values they mean, round by round over all snapshots: a
round joins only the names that are still open, at most six rounds deep. What cannot be known becomes ``*``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.operators.graph import P, store
from changegraph.operators.scopes import nearest_definition

#: Expressions nested deeper than this, by brackets, templates or values, are unknown.
MOST_DEPTH = 6
JVM = ("java", "kotlin")
#: Up to so many names, what they mean is sent to all tasks; beyond, it is joined by shuffle.
BROADCAST_NAMES = 100_000
_PART = "array<struct<kind:string,text:string,deep:int,down:int>>"
#: A quoted text (up to the end if it is never closed), an opening bracket, a closing one, or any other character.
_PIECE = re.compile(r"""("(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?)|([(\[{])|([)\]}])|(.)""", re.S)
#: In a template: a dollar that is meant, an expression in braces, a bare name.
_HOLE = re.compile(r"(\\\$)|\$\{([^}]*)\}?|\$(\w+)")


def split_outside(text: str, mark: str) -> list[str]:
    """Parts of the text between marks that are in no quotes and no brackets."""
    cuts, depth = [-1], 0
    for m in _PIECE.finditer(text):
        depth += (m[2] is not None) - (m[3] is not None)
        if m[4] == mark and not depth:
            cuts.append(m.start())
    return [text[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _is_name(x: str) -> bool:
    return bool(x) and not (x[0].isascii() and x[0].isdigit()) and all(c.isalnum() or c in "_$" for c in x)


def _quoted(x: str) -> str | None:
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'`" else None


class _Parser:
    """Cuts one expression into (kind, text, deep, down): ``deep`` is how deep the part stands, ``down`` where a value in its place would."""

    def __init__(self, kotlin: bool):
        self.kotlin, self.out = kotlin, []

    def expression(self, text: str, deep: int = 0) -> list[tuple]:
        if deep > MOST_DEPTH:
            self.out.append(("any", "", deep, deep))
            return self.out
        for term in map(str.strip, split_outside(text, "+")):
            inner = term
            while len(inner) > 1 and inner[0] == "(" and inner[-1] == ")":
                inner = inner[1:-1].strip()
            if inner != term and inner:
                self.expression(inner, deep + 1)
            elif inner:
                self.term(inner, deep, deep)
        return self.out

    def term(self, t: str, deep: int, down: int) -> None:
        body = _quoted(t)
        if t[0] == "`" and body is not None:
            self.template(body, deep, plain=False)
        elif len(t) > 5 and t[:3] == t[-3:] == '"""':
            self.out.append(("text", t[3:-3], deep, down))
        elif body is not None and self.kotlin and t[0] == '"' and "$" in body:
            self.template(body, deep, plain=True)
        elif body is not None:
            self.out.append(("text", re.sub(r"\\([/'\"])", r"\1", body), deep, down))
        else:
            # Of ``a ?: b``, ``a || b`` and ``a ?? b`` the first alternative counts.
            for mark in ("?:", "||", "??"):
                if mark in t:
                    first = t.split(mark, 1)[0].strip()
                    if first:
                        self.term(first, deep, down + 1)
                    else:
                        self.out.append(("any", "", deep, down))
                    return
            path = [x.rstrip("!?") for x in t.removeprefix("this.").split(".")]
            known = all(map(_is_name, path))
            own = "this." if t.startswith("this.") else ""
            self.out.append(("name", own + ".".join(path), deep, down) if known else ("any", "", deep, down))

    def template(self, body: str, deep: int, plain: bool) -> None:
        """``${expression}`` and, where ``plain``, ``$name`` are holes; ``\\$`` is a dollar."""
        text, at = "", 0
        for m in _HOLE.finditer(body):
            text, at = text + body[at : m.start()], m.end()
            if m[1] or m[3] and not plain:
                text += "$" if m[1] else m[0]
                continue
            self.out.append(("text", text, deep, deep))
            self.expression(m[3] or m[2], deep + 1)
            text = ""
        self.out.append(("text", text + body[at:], deep, deep))


def property_text(text: str, path: list[str]) -> str | None:
    """The expression of a property path in an object literal."""
    for key in path:
        text = text.strip()
        if text[:1] != "{" or text[-1:] != "}" or len(text) < 2:
            return None
        for pair in split_outside(text[1:-1], ","):
            k, colon, value = pair.partition(":")
            k = k.strip()
            if colon and (_quoted(k) if _quoted(k) is not None else k) == key:
                text = value.strip()
                break
        else:
            return None
    return text


def _cut(text: pd.Series, path: pd.Series, lang: pd.Series) -> pd.Series:
    def parts(t, p, g):
        t = None if t is None else property_text(t, list(p))
        return None if t is None else [dict(zip(("kind", "text", "deep", "down"), x)) for x in _Parser(g == "kotlin").expression(t)]

    return pd.Series([parts(*x) for x in zip(text, path, lang)])


def _parts(*columns) -> Column:
    """The parts of each expression (text, path, lang), or of the property of it that the path names; null if there is none."""
    return F.pandas_udf(_cut, _PART)(*columns)


def type_constants(seen: DataFrame, values: DataFrame, scopes: DataFrame) -> DataFrame:
    """(file, type_name, name, value_id, rank): the constants of types and of the scopes right in them, by the names that files know the types by.

    seen: (file, type_name, type_id, rank), the types that a name in a file may mean, the likeliest first."""
    own = values.where("scope_id IS NOT NULL").select(P, "value_id", "scope_id", "name", "ord")
    inner = own.join(scopes.where("parent_id IS NOT NULL").select(P, "scope_id", F.col("parent_id").alias("type_id")), [P, "scope_id"])
    every = own.withColumnRenamed("scope_id", "type_id").unionByName(inner.drop("scope_id"))
    return seen.join(every, [P, "type_id"]).select(P, "file", "type_name", "name", "value_id", F.struct("rank", "ord").alias("rank"))


def expand_templates(
    exprs: DataFrame, values: DataFrame, paths: DataFrame, imports: DataFrame, constants: DataFrame,
) -> DataFrame:
    """(expr_id, template, parts): each expression with known values in place; ``*`` and null parts for unknown ones.

    exprs: (expr_id, file, lang, scope_id, at, text); values: (value_id, file, lang, scope_id, name, at, ord, text), a
    null scope_id being the file's top level; paths as ``scope_paths`` gives; imports: (file, local, name, target_file) of
    scripts, a null target_file being outside; constants: (file, type_name, name, value_id, rank), the
    constants of types as each file of the JVM sees them by ``Type.NAME``, the least rank first.

    A name means, in this order: the last value above it in a callable around it, a field of a type
    around it, the file's first top-level value of the name, an imported constant, or for ``Type.NAME`` a
    type's constant. ``this.name`` is a field. Further names are properties of an object literal. A value
    that is only empty text is a default that is set later, so unknown; so is a value within itself.
    An unknown expression text has no parts and gives an empty template."""
    none = F.array().cast("array<string>")
    values = store(values.select(P, "value_id", "file", "lang", "scope_id", "name", "at", "ord", "text"))
    scoped = values.where("scope_id IS NOT NULL").select(P, "scope_id", "name", "at", "ord", F.lit(True).alias("field"), F.col("value_id").alias("value"))
    top = values.where("scope_id IS NULL").groupBy(P, "file", "name").agg(F.min_by("value_id", "ord").alias("found"))
    first = constants.groupBy(P, "file", "type_name", "name").agg(F.min_by("value_id", F.struct("rank", "value_id")).alias("found"))

    # Parsing is the work here, and files of expressions are small: deal them out, so that not one task parses all.
    begin = exprs.select(P, "expr_id", "file", "lang", "scope_id", "at", "text").repartition(P, "expr_id")
    begin = store(begin.select(P, "expr_id", "file", "lang", "scope_id", "at", _parts("text", none, "lang").alias("parts"), F.monotonically_increasing_id().alias("_row")))
    rows = begin.select(P, "expr_id", "_row", "file", "lang", "scope_id", "at", F.posexplode_outer("parts").alias("_i", "_p"))
    # What a name means depends on where it stands and not on the expression: the same names are expanded once.
    asks = F.struct("file", "lang", "scope_id", F.when(F.col("scope_id").isNotNull(), F.col("at")).alias("at"), F.col("_p.down").alias("down"), F.col("_p.text").alias("text"))
    kind = F.when(F.col("_p.deep") > MOST_DEPTH, "any").otherwise(F.col("_p.kind"))
    asking = (F.col("kind") == "name") & (F.col("_p.down") < MOST_DEPTH)
    rows = rows.withColumn("kind", kind).withColumn("_ask", F.when(asking, F.to_json(asks)))
    asked = rows.where("_ask IS NOT NULL").select(P, F.col("_ask").alias("expr_id"), asks.alias("_a")).distinct()
    names = store(asked.select(P, "expr_id", "_a.*", F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("within")))
    n_asked, done = names.count(), []
    while not names.isEmpty():
        names = names.withColumn("own", F.col("text").startswith("this.")).withColumn("path", F.split(F.regexp_replace("text", r"^this\.", ""), r"\.")).withColumn("name", F.col("path")[0])
        names = names.withColumn("use_id", F.to_json(F.struct("expr_id", "place")))
        uses = names.where("scope_id IS NOT NULL").select(P, "use_id", "scope_id", "name", "at", F.col("own").alias("fields_only"))
        here = nearest_definition(uses, scoped, paths).select(P, "use_id", F.col("found").alias("_a"))
        up = names.where("NOT own").join(top, [P, "file", "name"]).select(P, "use_id", F.col("found").alias("_b"))
        script = names.where(~F.col("lang").isin(*JVM)).join(imports.select(P, "file", F.col("local").alias("name"), F.col("name").alias("_name"), "target_file"), [P, "file", "name"])
        script = script.join(top.select(P, F.col("file").alias("target_file"), F.col("name").alias("_name"), "found"), [P, "target_file", "_name"])
        script = script.groupBy(P, "use_id").agg(F.min("found").alias("_c"))
        typed = names.where(F.col("lang").isin(*JVM) & (F.size("path") > 1)).select(P, "use_id", "file", F.col("name").alias("type_name"), F.col("path")[1].alias("name"))
        typed = typed.join(first, [P, "file", "type_name", "name"]).select(P, "use_id", F.col("found").alias("_d"))
        for found in (here, up, script, typed):
            names = names.join(found, [P, "use_id"], "left")
        constant = F.col("_a").isNull() & F.col("_b").isNull() & F.col("_c").isNull()
        names = names.withColumn("value_id", F.coalesce("_a", "_b", "_c", "_d")).withColumn("rest", F.slice("path", F.when(constant, 3).otherwise(2), F.size("path")))
        value = values.select(P, "value_id", *[F.col(c).alias(f"_{c}") for c in ("file", "lang", "scope_id", "at", "text")])
        names = names.join(value, [P, "value_id"], "left")
        fresh = F.col("value_id").isNotNull() & ~F.array_contains("within", F.col("value_id"))
        names = names.withColumn("parts", F.when(fresh, _parts("_text", "rest", "_lang")))
        empty = F.forall("parts", lambda p: (p["kind"] == "text") & (p["text"] == ""))
        # A value stands one level deeper than its name.
        names = store(names.select(
            P, "expr_id", "place", F.col("_file").alias("file"), F.col("_lang").alias("lang"), F.col("_scope_id").alias("scope_id"), F.col("_at").alias("at"),
            F.array_append("within", F.col("value_id")).alias("within"), (F.col("down") + 1).alias("base"), F.when(~empty, F.col("parts")).alias("parts"),
        ))
        done.append(names.where("parts IS NULL").select(P, "expr_id", "place", F.lit(None).cast("string").alias("text")))
        inner = names.select(*[c for c in names.columns if c != "parts"], F.posexplode("parts").alias("_i", "_p"))
        inner = inner.withColumn("place", F.array_append("place", F.col("_i"))).withColumn("_deep", F.col("base") + F.col("_p.deep"))
        kind = F.when(F.col("_deep") > MOST_DEPTH, "any").otherwise(F.col("_p.kind"))
        inner = store(inner.select(P, "expr_id", "file", "lang", "scope_id", "at", "place", "within", (F.col("base") + F.col("_p.down")).alias("down"), kind.alias("kind"), F.col("_p.text").alias("text")))
        done.append(inner.where(f"kind <> 'name' OR down >= {MOST_DEPTH}").select(P, "expr_id", "place", F.when(F.col("kind") == "text", F.col("text")).alias("text")))
        names = inner.where(f"kind = 'name' AND down < {MOST_DEPTH}").drop("kind")
    if done:
        known = done[0]
        for df in done[1:]:
            known = known.unionByName(df)
        known = known.groupBy(P, F.col("expr_id").alias("_ask")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("_texts"))
        rows = rows.join(F.broadcast(known) if n_asked <= BROADCAST_NAMES else known, [P, "_ask"], "left")
    else:
        rows = rows.withColumn("_texts", F.lit(None).cast("array<struct<text:string>>"))
    # An expression without a text has no part.
    plain = F.when(F.col("kind").isNull(), F.array().cast("array<struct<text:string>>")).otherwise(F.array(F.struct(F.when(F.col("kind") == "text", F.col("_p.text")).alias("text"))))
    rows = rows.select(P, "expr_id", "_row", "_i", F.coalesce("_texts", plain).alias("_t"))
    texts = rows.groupBy("_row", P).agg(F.first("expr_id").alias("expr_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"])).alias("_parts"))

    def joined(acc, p):
        """Neighbouring texts are one part, neighbouring unknowns too."""
        last = F.element_at(acc, -1)
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        both = F.size(acc) > 0
        return (
            F.when(both & p["text"].isNull() & last["text"].isNull(), acc)
            .when(both & p["text"].isNotNull() & last["text"].isNotNull(), F.array_append(rest, F.struct(F.concat(last["text"], p["text"]).alias("text"))))
            .otherwise(F.array_append(acc, F.struct(p["text"].alias("text"))))
        )

    texts = texts.withColumn("parts", F.aggregate("_parts", F.array().cast("array<struct<text:string>>"), joined))
    return texts.select(P, "expr_id", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("*"))), "").alias("template"), "parts")

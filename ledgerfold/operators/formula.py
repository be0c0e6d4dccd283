"""User formulas over norms, such as ``0,5*[n1] + [n2]``.

References are resolved by joins; the arithmetic of an expression is one fold
over its tokens (user text is never evaluated as code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import WS, let, strip

# --- fixed values: token shape, references and error texts --------------------
TOKEN = r"(\[[^\]]+\]|\d+(?:[.,]\d+)?|[()+\-*/])"
REFERENCE = r"\[([^\]]+)\]"
NAMED_REFERENCE = r"\[@([^\]]+)\]"
EMPTY = "Формула пуста"
BREAKS_OFF = "Формула обрывается — не хватает значения"
UNCLOSED = "Не хватает закрывающей скобки"
ZERO_DIVISION = "Деление на ноль"
NO_NUMBER = "Не число: «%s»"
EXTRA = "Лишний фрагмент: «%s»"
UNKNOWN_SIGN = "Непонятный символ в позиции %d: «%s»"
UNKNOWN_NORMS = "Неизвестные нормативы: "

def tokens(expression: Column) -> Column:
    return F.regexp_extract_all(expression, F.lit(TOKEN), F.lit(1))


def has_unknown_sign(expression: Column) -> Column:
    """Whether something is left once all tokens and spaces are taken out."""
    return F.regexp_replace(expression, rf"{TOKEN}|{WS}", "") != ""


def references(expression: Column) -> Column:
    """Norm ids a formula refers to, in order."""
    return F.transform(F.regexp_extract_all(expression, F.lit(REFERENCE), F.lit(1)), lambda inner: strip(inner))


def _token_values(tokens_: Column, ids: Column, values: Column) -> Column:
    """Tokens with their place and, of numbers and references, their value; a reference without one is missing."""

    def one(t: Column, i: Column) -> Column:
        named = t.startswith("[")
        inner = strip(F.substr(t, F.lit(2), F.length(t) - 2))
        found = F.get(values, F.coalesce(F.array_position(ids, inner), F.lit(0)).cast("int") - 1)
        number = F.when(named, found).otherwise(F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
        missing = named & ~F.coalesce(F.abs(found) < float("inf"), F.lit(False))
        return F.struct(
            t.alias("t"), i.cast("int").alias("i"), (named | t.rlike(r"^\d")).alias("is_value"),
            F.when(missing, 0.0).otherwise(number).alias("value"), missing.alias("missing"),
        )

    return F.transform(tokens_, one)


_FRAME = {"sum": "double", "op": "string", "prod": "double", "mul": "string", "neg": "boolean"}
_FRAMES = f"array<struct<{','.join(f'{n}:{t}' for n, t in _FRAME.items())}>>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _combined(frame: Column) -> Column:
    """Value of a sum whose last product is done."""
    return (
        F.when(frame["op"].isNull(), frame["prod"]).when(frame["op"] == "+", frame["sum"] + frame["prod"]).otherwise(frame["sum"] - frame["prod"])
    )


def _unknown_sign(text: Column, tokens_: Column) -> Column:
    """Message on the first sign, after the last token before it, that begins no token."""
    gaps = F.split(text, TOKEN)
    first = F.array_position(F.transform(gaps, lambda g: strip(g) != ""), True).cast("int") - 1
    lengths = lambda parts: F.aggregate(F.slice(parts, F.lit(1), first), F.lit(0), lambda acc, x: acc + F.length(x))
    at = lengths(gaps) + lengths(tokens_)
    return F.when(first >= 0, F.format_string(UNKNOWN_SIGN, at + 1, F.substr(text, at + 1, F.lit(1))))


def evaluate(expression: Column, ids: Column, values: Column) -> Column:
    """Value and error of a formula, given its references (two arrays of equal length).

    One fold over the tokens: a machine with a stack of open brackets, each with
    the sum and the product it has come to, and the sign and operator that wait for
    a value.  Products are worked out as soon as their right side is there, so the
    first error from the left is told.
    """
    text = F.coalesce(expression, F.lit(""))

    def machine(listed: Column) -> Column:
        start = F.struct(
            F.array().cast(_FRAMES).alias("stack"), *[(F.lit(False) if n == "neg" else _none(t)).alias(n) for n, t in _FRAME.items()],
            F.lit(False).alias("ready"), F.lit(False).alias("missing"), _none("string").alias("error"),
        )

        def step(acc: Column, x: Column) -> Column:
            def state(**changes: Column) -> Column:
                return F.struct(*[changes.get(n, acc[n]).alias(n) for n in ("stack", *_FRAME, "ready", "missing", "error")])

            t, ready, depth = x["t"], acc["ready"], F.size(acc["stack"])
            closes = ready & (t == ")") & (depth > 0)
            parent = F.get(acc["stack"], depth - 1)
            frame = {n: F.when(closes, parent[n]).otherwise(acc[n]) for n in _FRAME}
            plain = F.when(closes, _combined(acc)).otherwise(x["value"])
            value = F.when(frame["neg"], -plain).otherwise(plain)
            product = (
                F.when(frame["mul"].isNull(), value).when(frame["mul"] == "*", frame["prod"] * value).otherwise(F.try_divide(frame["prod"], value))
            )
            by_zero = F.coalesce(frame["mul"] == "/", F.lit(False)) & (value == 0)
            taken = state(
                stack=F.when(closes, F.slice(acc["stack"], F.lit(1), depth - 1)).otherwise(acc["stack"]),
                sum=frame["sum"], op=frame["op"], prod=product, mul=_none("string"), neg=F.lit(False), ready=F.lit(True),
                missing=acc["missing"] | (~closes & x["missing"]), error=F.when(by_zero, F.lit(ZERO_DIVISION)),
            )
            own = F.struct(*[acc[n].alias(n) for n in _FRAME])
            opened = state(stack=F.concat(acc["stack"], F.array(own)), **{n: F.lit(False) if n == "neg" else _none(k) for n, k in _FRAME.items()})
            summed = state(sum=_combined(acc), op=t, prod=_none("double"), mul=_none("string"), ready=F.lit(False))
            rest = F.array_join(F.transform(F.slice(listed, x["i"] + 1, F.size(listed)), lambda y: y["t"]), " ")
            left_over = F.when(depth > 0, F.lit(UNCLOSED)).otherwise(F.format_string(EXTRA, rest))
            return (
                F.when(acc["error"].isNotNull(), acc)
                .when((~ready & x["is_value"]) | closes, taken)
                .when(~ready & t.isin("+", "-"), state(neg=F.when(t == "-", ~acc["neg"]).otherwise(acc["neg"])))
                .when(~ready & (t == "("), opened)
                .when(~ready, state(error=F.format_string(NO_NUMBER, t)))
                .when(t.isin("*", "/"), state(mul=t, ready=F.lit(False)))
                .when(t.isin("+", "-"), summed)
                .otherwise(state(error=left_over))
            )

        def finish(acc: Column) -> Column:
            error = (
                F.when(acc["error"].isNotNull(), acc["error"])
                .when(F.size(listed) == 0, F.lit(EMPTY))
                .when(~acc["ready"], F.lit(BREAKS_OFF))
                .when(F.size(acc["stack"]) > 0, F.lit(UNCLOSED))
            )
            return F.struct(F.when(error.isNull() & ~acc["missing"], _combined(acc)).alias("value"), error.alias("error"))

        return F.aggregate(listed, start, step, finish)

    def told(found: Column) -> Column:
        sign = _unknown_sign(text, found)
        wrong = F.struct(_none("double").alias("value"), sign.alias("error"))
        return F.when(sign.isNotNull(), wrong).otherwise(let(_token_values(found, ids, values), machine))

    return let(tokens(text), told)


def resolve(rules: DataFrame, norms: DataFrame) -> DataFrame:
    """``rules(key, expression)`` with the mass and volume of their references.

    Adds ``ids, masses, volumes`` (aligned arrays) and ``unknown`` ids.  The
    references of a formula are joined to the norms, so nothing is broadcast
    that grows with them.
    """
    named = rules.select("key", F.posexplode(references(F.col("expression"))).alias("at", "id"))
    known = norms.select("id", "mass", "volume", F.lit(True).alias("known"))
    found = named.join(known, "id", "left").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("at", "id", "mass", "volume", "known"))).alias("refs")
    )
    refs = F.coalesce("refs", F.array().cast("array<struct<at:int,id:string,mass:double,volume:double,known:boolean>>"))
    return rules.join(found, "key", "left").select(
        *rules.columns,
        F.transform(refs, lambda r: r["id"]).alias("ids"),
        F.transform(refs, lambda r: r["mass"]).alias("masses"),
        F.transform(refs, lambda r: r["volume"]).alias("volumes"),
        F.transform(F.filter(refs, lambda r: r["known"].isNull()), lambda r: r["id"]).alias("unknown"),
    )


def evaluate_rules(rules: DataFrame, norms: DataFrame) -> DataFrame:
    """Mass and volume of every formula; an error in either takes both."""
    resolved = resolve(rules.select("key", "expression"), norms)
    of = lambda values: evaluate(F.col("expression"), F.col("ids"), F.col(values))
    done = resolved.withColumns({"m": of("masses"), "v": of("volumes")})
    error = F.coalesce("m.error", "v.error")
    return done.select(
        "key",
        F.when(error.isNull(), F.col("m.value")).alias("formula_mass"),
        F.when(error.isNull(), F.col("v.value")).alias("formula_volume"),
        error.alias("formula_error"),
    )


def unknown_references(rules: DataFrame, norms: DataFrame) -> DataFrame:
    """References that name no norm, one row each."""
    named = rules.select("key", F.posexplode(references(F.col("expression"))).alias("at", "id"))
    return named.join(norms.select("id"), "id", "left_anti").select("key", "at", "id")


def validate(rules: DataFrame, norms: DataFrame) -> DataFrame:
    """First problem of every formula, or null: signs, then references, then form."""
    resolved = resolve(rules.select("key", "expression"), norms)
    ones = F.transform("ids", lambda _: F.lit(1.0))
    tried = resolved.withColumn("ones", ones).withColumn("t", evaluate(F.col("expression"), F.col("ids"), F.col("ones")))
    unknown = F.concat(F.lit(UNKNOWN_NORMS), F.array_join("unknown", ", "))
    return tried.select(
        "key",
        "expression",
        F.when(has_unknown_sign(F.col("expression")), F.col("t.error"))
        .when(F.size("unknown") > 0, unknown)
        .otherwise(F.col("t.error"))
        .alias("problem"),
    )


def replace_references(rules: DataFrame, table: DataFrame, pattern: str, key: Column, before: str, after: str) -> DataFrame:
    """Rewrite references by a lookup ``table(ref, replacement)``; unknown ones stay.

    ``pattern`` finds the text inside the brackets, ``key`` turns it (as column
    ``inner``) into the lookup key, ``before``/``after`` enclose the replacement.
    """
    inner = rules.select("key", F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(pattern), F.lit(1)))).alias("inner"))
    found = (
        inner.withColumn("ref", key)
        .join(table, "ref")
        .groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("inner", "replacement"))).alias("changes"))
    )
    opening = "[@" if pattern == NAMED_REFERENCE else "["
    # one pass: the texts between the references, each with what follows it
    cut_up = rules.join(found, "key", "left").withColumns(
        {"texts": F.split("expression", pattern), "inners": F.regexp_extract_all("expression", F.lit(pattern), F.lit(1))}
    )

    def with_reference(inner: Column, at: Column) -> Column:
        new = F.concat(F.lit(before), F.try_element_at("changes", inner), F.lit(after))
        return F.concat(F.get("texts", at), F.coalesce(new, F.concat(F.lit(opening), inner, F.lit("]"))))

    changed = F.concat(F.array_join(F.transform("inners", with_reference), ""), F.get("texts", F.size("inners")))
    return cut_up.withColumn("expression", F.when(F.col("changes").isNull(), F.col("expression")).otherwise(changed)).drop(
        "changes", "texts", "inners"
    )


def humanize(rules: DataFrame, norms: DataFrame) -> DataFrame:
    """Formulas with norm names in guillemets in place of ids."""
    table = norms.select(F.col("id").alias("ref"), F.col("name").alias("replacement")).filter("replacement <> ''")
    return replace_references(rules, table, REFERENCE, strip(F.col("inner")), "«", "»")


def portable(rules: DataFrame, norms: DataFrame) -> DataFrame:
    """Formulas with ``[@name]`` in place of ``[id]``, to outlive a new numbering."""
    table = norms.select(F.col("id").alias("ref"), F.col("name").alias("replacement"))
    return replace_references(rules, table, r"\[([^\]@]+)\]", strip(F.col("inner")), "[@", "]")

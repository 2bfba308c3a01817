"""Pseudonyms: their form, the policies of restoring, and finding tokens and what they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.normalize import choose

# Brackets of tokens, three grammars of tokens, default policies.
OPEN, CLOSE = "〔", "〕"
TOKEN_FORM = r"\A@[A-Z]-[A-Z0-9]+(?:-[A-Z0-9]+)*\z"
STORED_TOKEN_FORM = r"\A@[A-Z]-[A-Z0-9]+\z"
TOKEN_REFERENCE = r"(?<![A-Za-z0-9-])@[A-Z]-[A-Z0-9-]+(?![A-Za-z0-9-])"
POLICIES = {
    "PERSON_NAME": "ALWAYS_RESTORE",
    "ORG_NAME": "ALWAYS_RESTORE",
    "ADDRESS": "ALWAYS_RESTORE",
    "PHONE": "RESTORE_ON_REQUEST",
    "EMAIL": "RESTORE_ON_REQUEST",
    "ID_CARD": "RESTORE_ON_REQUEST",
    "BANK_ACCOUNT": "NEVER_RESTORE",
}


def default_policy(value_type: Column) -> Column:
    return choose(value_type, POLICIES)


def pseudonym(alias: Column, token: Column) -> Column:
    """Alias and bracketed token; null where either may not be used."""
    good = (F.trim(alias) != "") & ~alias.rlike(f"[{OPEN}{CLOSE}\r\n]") & token.rlike(TOKEN_FORM)
    return F.when(good, F.concat(alias, F.lit(OPEN), token, F.lit(CLOSE)))


def leaks(text: Column, values: Column) -> Column:
    """Whether a text holds any of an array of values."""
    return F.coalesce(F.exists(values, lambda v: F.contains(text, v)), F.lit(False))


def token_references(text: Column) -> Column:
    """Tokens in a text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN_REFERENCE), F.lit(0))


def unresolved_tokens(text: Column) -> Column:
    """Distinct tokens in a text, sorted."""
    return F.array_sort(F.array_distinct(token_references(text)))


#: A token in brackets, or bare.
REFERENCE = f"{OPEN}{TOKEN_REFERENCE}{CLOSE}|{TOKEN_REFERENCE}"


def _alnum(char: Column) -> Column:
    return char.rlike("[A-Za-z0-9]")


def replacements(text: Column, references: Column, targets: Column) -> Column:
    """array<struct<start, end, value>> of the references of a text that are restored.

    ``references``: spans of REFERENCE in order; ``targets``: array of (token, value,
    aliases).  A bare token becomes the value.  A bracketed one does so with the longest
    alias right before it; without such an alias, or with one that is only the end of a
    longer word or reaches into what was restored before, it stays.
    """
    kind = "array<struct<start:int,end:int,value:string>>"

    def one(m: Column) -> Column:
        bracketed = m["value"].startswith(OPEN)
        token = F.when(bracketed, F.substring(m["value"], F.lit(2), F.length(m["value"]) - 2)).otherwise(m["value"])
        t = F.filter(targets, lambda x: x["token"] == token)
        char = lambda at: F.substring(text, at + 1, F.lit(1))
        begin = lambda a: m["start"] - F.length(a)
        fits = lambda a: (F.length(a) > 0) & (begin(a) >= 0) & (F.substring(text, begin(a) + 1, F.length(a)) == a) & ((begin(a) == 0) | ~(_alnum(char(begin(a))) & _alnum(char(begin(a) - 1))))
        of = lambda t: F.struct(F.when(bracketed, F.array_min(F.transform(F.filter(t[0]["aliases"], fits), begin))).otherwise(m["start"]).alias("start"), m["end"].alias("end"), t[0]["value"].alias("value"))
        return F.when((F.size(t) > 0) & (F.length(t[0]["value"]) > 0), of(t))

    def step(done: Column, r: Column) -> Column:
        open_ = (F.size(done) == 0) | (r["start"] >= F.element_at(done, -1)["end"])
        return F.when(r["start"].isNotNull() & open_, F.concat(done, F.array(r))).otherwise(done)

    found = F.filter(F.transform(references, one), lambda r: r.isNotNull() & r["start"].isNotNull())
    return F.aggregate(found, F.array().cast(kind), lambda done, r: step(done, F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"), r["value"].alias("value"))))

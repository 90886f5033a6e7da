"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

All of it is SQL functions. A kind's matches and the text between them come from the same
pattern (``regexp_extract_all`` and ``split``), so that positions follow from lengths.

Kinds, in their order in results: email, ip, card and phone are the base and stand whenever
their form and their check (parts of at most 255, Luhn, number of digits) hold. Added kinds are
kept only if their score reaches ``THRESHOLD``:

* ``iban``: mod-97 must hold; that alone suffices.
* ``national_id``: nine digits as 3-2-4; needs a context word close by.
* ``local_phone``: digits in three groups without a plus sign; needs a context word.
* ``secret``: 20 or more letters and digits, both occurring; needs a context word before it.

The score of a candidate is its kind's value in ``SCORES``, plus ``CONTEXT`` if one of the kind's
words stands in the ``REACH`` code points before it, less ``CONTEXT`` if a word stands there that
speaks against it (order, invoice, version and the like). An added span that overlaps a base
span is left out.

Null and empty texts have no spans. Patterns use possessive quantifiers and begin at the start
of runs, so that time is linear in the text also for very long tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# "\G|": a match may also begin where the last one ended, as an unanchored search would.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
            r"(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{20,}+",
}
# A cheaper pattern that every text with a match meets: one search spares most texts two.
HINTS = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}",
    "phone": r"\+[0-9]", "iban": r"[A-Z][0-9]{2}[ A-Z0-9]", "national_id": r"-[0-9]{2}-[0-9]{4}",
    "local_phone": r"[0-9][) .-]++[0-9]{3,4}[ .-][0-9]{3}", "secret": r"[0-9][A-Za-z_]|[A-Za-z_][0-9]",
}
KINDS = tuple(PATTERNS)
BASE, ADDED = KINDS[:4], KINDS[4:]
THRESHOLD, CONTEXT, REACH = 0.6, 0.4, 24
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "national_id": 0.4,
          "local_phone": 0.3, "secret": 0.3}
WORDS = {
    "email": "mail|contact", "ip": r"\bip\b|host|server|address",
    "card": "card|visa|credit|carte|karte|tarjeta", "phone": r"phone|\btel|\bcall|mobile|\bfax",
    "iban": "iban|account|konto|compte|cuenta", "national_id": r"\bssn|social|national|identity",
    "local_phone": r"phone|\btel|\bcall\b|mobile|\bcell|\bfax",
    "secret": r"token|secret|password|passwd|api.?key|access.?key|credential",
}
AGAINST = r"\border|invoice|version|\bisbn|serial|commit|checksum"
SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _none(kind: str = SPAN) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _at(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


def luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn check."""
    def step(s, i):
        value = _at(digits, F.length(digits) - i + 1).cast("int")
        return s + F.when(i % 2 == 1, value).otherwise(value * 2 - F.when(value > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def mod97(code: Column) -> Column:
    """Whether 15 to 34 letters and digits pass the ISO 7064 mod-97 check."""
    code = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(r, i):
        c = _at(turned, i)
        return F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step)
    return F.when(F.length(code).between(15, 34), rest == 1).otherwise(False)


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "local_phone":
        return F.length(_digits(hit)).between(7, 11)
    return mod97(hit) if kind == "iban" else F.lit(True)


def _score(kind: str, before: Column) -> Column:
    if kind == "iban":
        return F.lit(SCORES[kind])                  # its check suffices, whatever stands before
    return (F.lit(SCORES[kind]) + F.when(before.rlike(WORDS[kind]), CONTEXT).otherwise(0.0)
            - F.when(before.rlike(AGAINST), CONTEXT).otherwise(0.0))


def _taken(kind: str, hit: Column) -> Column:
    """The part of a match that is valid, null if none is. An account number may have taken in the
    capitals after it: it is tried without its last group as well."""
    whole = F.when(_valid(kind, hit), hit)
    if kind != "iban":
        return whole
    less = F.regexp_replace(hit, " [A-Z0-9]{1,4}$", "")
    return F.coalesce(whole, F.when(_valid(kind, less), less))


def spans_of(text: Column, kind: str) -> Column:
    """The valid matches of one kind: leftmost, not overlapping, failing ones dropped."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)
    found = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"),
                             F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))

    def placed(x):
        pairs = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), x["hits"],
                           lambda g, h: F.struct(F.length(g).cast("int").alias("gap"),
                                                 F.length(h).cast("int").alias("size"),
                                                 h.alias("hit")))

        def step(s, p):
            start, end = s["at"] + p["gap"], s["at"] + p["gap"] + p["size"]
            before = F.lower(F.substring(text, F.greatest(F.lit(1), start - REACH + 1),
                                         F.least(F.lit(REACH), start)))
            taken = _taken(kind, p["hit"])
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"),
                            (start + F.length(taken)).cast("int").alias("end"),
                            F.lit(kind).alias("kind"), _score(kind, before).alias("score"))
            return F.struct(
                F.when(taken.isNotNull(), F.concat(s["out"], F.array(span)))
                .otherwise(s["out"]).alias("out"), end.alias("at"))

        return F.aggregate(pairs, F.struct(_none().alias("out"), F.lit(0).alias("at")), step)["out"]

    return F.when(text.rlike(HINTS[kind]), F.element_at(F.transform(found, placed), 1)).otherwise(
        _none())


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: base spans, and all spans, in order of position."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({f"_{k}": spans_of(body, k) for k in KINDS})
    out = out.withColumn("_base", F.array_sort(F.concat(*[f"_{k}" for k in BASE])))
    added = F.filter(F.concat(*[f"_{k}" for k in ADDED]), lambda a: (
        a["score"] >= THRESHOLD) & ~F.exists(
            "_base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return out.withColumn("_spans", F.array_sort(F.concat("_base", added))).drop(
        *[f"_{k}" for k in KINDS])


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base spans, a digest of them, and all spans.

    One row for each row of ``docs``; only ``doc_id`` and ``text`` are used. Positions count
    code points, the end is exclusive.
    """
    found = with_spans(docs.select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts,
                        F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and angle brackets.

    Of overlapping spans the first, and of those the longest, names the place; all their
    characters go. Rows without spans are unchanged; a null text stays null. ``n_chars``, if there
    is such a column, counts the new text.
    """
    rows = docs.select(F.struct("*").alias("_row")).select(
        "_row", F.col("_row")[text].alias("_text"))
    found = with_spans(rows, "_text")

    def merge(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"),
                          F.greatest(last["end"], s["end"]).alias("end"),
                          last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                               F.array(joined))).otherwise(F.concat(done, F.array(own)))

    kind = "struct<start:int,end:int,kind:string>"
    merged = found.withColumn("_merged", F.aggregate("_spans", _none(kind), merge))
    edges = F.concat(F.array(F.lit(0)), F.transform("_merged", lambda s: s["end"]))
    pieces = F.zip_with(edges, F.col("_merged"), lambda at, s: F.when(
        s.isNull(), F.substring(F.col("_text"), at + 1, F.length("_text"))).otherwise(F.concat(
            F.substring(F.col("_text"), at + 1, s["start"] - at),
            F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
    new = F.when(F.size("_merged") > 0, F.array_join(pieces, "")).otherwise(F.col("_text"))
    return renewed(merged.withColumn("_new", new), docs, text, F.size("_merged") > 0)


def renewed(rows: DataFrame, docs: DataFrame, text: str, changed: Column) -> DataFrame:
    """The columns of ``docs``, kept in the struct ``_row``, with ``_new`` as their text."""
    out = []
    for field in docs.schema:
        value = F.col("_row")[field.name]
        if field.name == text:
            value = F.col("_new")
        elif field.name == "n_chars":
            value = F.when(changed, F.length("_new").cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return rows.select(*out)

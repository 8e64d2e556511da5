"""Format-preserving pseudonyms for personal numbers and dates, in native expressions.

A value is found by its pattern, validated (calendar, check digits, octets), and permuted by
a keyed Feistel network within its own format; check digits are computed anew.  The
permutation depends on the key and the kind alone, so equal values stay linked across
documents and different values stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.registry import fresh

ROUNDS = 10

# A match begins where no run of its own characters goes on, so each run is tried once.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "phone": r"(?<![\w+])\+?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "number": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
}
KINDS = ["email", "iban", "date", "ip", "phone", "ssn", "card", "account"]
ANY = "|".join(PATTERNS.values())
STOP = "\ufdd0"  # a noncharacter: set behind a value which its pattern would take too far
DAYS = 270 * 270  # dates of 1900-01-01 and so many days are permuted among themselves


def _digest(key: str, kind: str, turn: Column, half: Column, size: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), size.cast("string"), half.cast("string")), 256)


def _word16(digest: Column, i: Column) -> Column:
    """The i-th 16-bit number of a digest, counted around."""
    return F.conv(F.substring(digest, i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _turned(c: Column, k: Column) -> Column:
    """A digit or letter moved on within its class; others stay."""
    code = F.ascii(c)

    def ring(first: int, size: int) -> Column:
        return F.chr(F.lit(first) + (code - first + k) % size)

    return (
        F.when(code.between(48, 57), ring(48, 10)).when(code.between(97, 122), ring(97, 26))
        .when(code.between(65, 90), ring(65, 26)).otherwise(c)
    )


def permuted_text(value: Column, key: str, kind: str) -> Column:
    """Feistel network over the halves of a text; classes of characters keep their places."""
    size = F.length(value)
    half = (size / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, size).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        digest = _digest(key, kind, i, s["b"], size)
        # the digest is bound as the accumulator's companion so that it is computed once
        moved = F.array_join(
            F.transform(
                F.array(F.struct(digest.alias("d"))),
                lambda d: F.array_join(
                    F.transform(F.split(s["a"], ""), lambda c, j: _turned(c, _word16(d["d"], j))), ""
                ),
            ), "",
        )
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.transform(F.array(end), lambda s: F.concat(s["a"], s["b"]))[0]


def permuted_number(value: Column, base: int, key: str, kind: str) -> Column:
    """Feistel network over two digits to ``base``: a permutation of 0 .. base * base - 1."""
    start = F.struct(F.floor(value / base).cast("long").alias("a"), (value % base).cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        digest = _digest(key, kind, i, s["b"], F.lit(base))
        moved = (s["a"] + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")) % base
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.transform(F.array(end), lambda s: s["a"] * base + s["b"])[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; from the right, places with number % 2 == ``doubled`` count double."""
    def place(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), place), F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """Letters count as 10 to 35."""
    numbers = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(numbers, F.lit(0), lambda s, n: F.when(n > 9, s * 100 + n).otherwise(s * 10 + n) % 97)


def _day(value: Column) -> Column:
    """Days since 1900 of a date in one of the three notations, null if there is none."""
    slash = F.coalesce(F.try_to_date(value, "M/d/yyyy"), F.try_to_date(value, "d/M/yyyy"))
    date = (
        F.when(value.contains("/"), slash).when(value.contains("."), F.try_to_date(value, "d.M.yyyy"))
        .otherwise(F.try_to_date(value, "yyyy-MM-dd"))
    )
    return F.datediff(date, F.lit("1900-01-01").cast("date"))


def _is_iban(bare: Column) -> Column:
    return F.length(bare).between(15, 34) & (_mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)


def natural_end(value: Column) -> Column:
    """Length of the IBAN or card that a match begins with, null if there is none: it ends
    where a word of the match ends.  A first word which is a card is one, otherwise the
    longest counts."""
    ends = F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i + 1, F.lit(1)).isin("", " ", "-"))

    def longest(valid) -> Column:
        return F.array_max(F.filter(ends, lambda i: valid(F.substring(value, F.lit(1), i))))

    def card(v: Column) -> Column:
        return F.length(_digits(v)).between(13, 19) & (_luhn(_digits(v), 1) % 10 == 0)

    word = F.substring_index(F.substring_index(value, " ", 1), "-", 1)
    number = value.rlike("^[0-9]+[ -][0-9 -]*$") & ~value.rlike(f"^(?:{PATTERNS['phone']})$")
    return (
        F.when(value.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]* [A-Z0-9 ]*$"), longest(lambda v: _is_iban(F.regexp_replace(v, " ", ""))))
        .when(number, F.when(card(word), F.length(word)).otherwise(longest(card)))
    )


def late_start(value: Column) -> Column:
    """How many characters of a run of digits lie before a card which ends it, null if none
    does; the longest card counts."""
    starts = F.filter(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, F.lit(1)).isin(" ", "-"))

    def card(i: Column) -> Column:
        digits = _digits(F.substring(value, i + 1, F.length(value)))
        return F.length(digits).between(13, 19) & (_luhn(digits, 1) % 10 == 0)

    number = value.rlike("^[0-9]+[ -][0-9 -]*$") & ~value.rlike(f"^(?:{PATTERNS['phone']})$")
    return F.when(number & (_luhn(_digits(value), 1) % 10 != 0), F.array_min(F.filter(starts, card)))


def _stopped(value: Column) -> Column:
    """A match with a mark where a value inside it ends or, if it begins with none, begins."""
    def marked(at: Column) -> Column:
        return F.concat(F.substring(value, F.lit(1), at), F.lit(STOP), F.substring(value, at + 1, F.length(value)))

    return F.transform(F.array(F.struct(natural_end(value).alias("e"), late_start(value).alias("s"))), lambda x: F.coalesce(
        F.when(x["e"] < F.length(value), marked(x["e"])), F.when(x["e"].isNull(), marked(x["s"])), value))[0]


def _all_stopped(text: Column, passes: Column) -> Column:
    """The text with all its marks: a mark lets the search begin anew behind it, so what
    follows a value is looked at in the next pass.  A match holds two values at most."""
    def once(own: Column, _: Column) -> Column:
        found = F.transform(F.regexp_extract_all(own, F.lit(ANY), 0), _stopped)
        return F.array_join(F.flatten(F.zip_with(
            F.split(own, ANY), found, lambda gap, value: F.array(gap, F.coalesce(value, F.lit("")))
        )), "")

    return F.aggregate(F.sequence(F.lit(1), passes), text, once)


def _with_separators(bare: Column, value: Column) -> Column:
    """The characters of ``bare`` in the places which ``value`` has for them."""
    kept = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[ -]", ""))
    return F.array_join(F.transform(
        F.split(value, ""), lambda c, i: F.when(c.isin(" ", "-"), c).otherwise(F.substring(bare, kept(i), F.lit(1)))), "")


def kind_of(value: Column) -> Column:
    """The kind of a match, null if it does not validate."""
    day, bare = _day(value), F.regexp_replace(value, " ", "")
    octets = F.split(value, "\\.")
    full = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    iban = _is_iban(bare)
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike("^[A-Z]"), F.when(iban, "iban"))
        .when(value.rlike(full["date"]), F.when(day.between(0, DAYS - 1), "date"))
        .when(value.rlike(full["ip"]), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(value.rlike(full["phone"]), "phone")
        .when(value.rlike(full["ssn"]), "ssn")
        .otherwise(F.when(_luhn(_digits(value), 1) % 10 == 0, "card").otherwise("account"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind; a null kind leaves it as it is."""
    at = F.instr(value, "@")
    email = F.concat(permuted_text(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))
    moved = F.date_add(F.lit("1900-01-01").cast("date"), permuted_number(_day(value), 270, key, "date").cast("int"))
    padded = F.length(value) == 10
    date = (
        F.when(value.contains("/"), F.when(padded, F.date_format(moved, "MM/dd/yyyy")).otherwise(F.date_format(moved, "M/d/yyyy")))
        .when(value.contains("."), F.when(padded, F.date_format(moved, "dd.MM.yyyy")).otherwise(F.date_format(moved, "d.M.yyyy")))
        .otherwise(F.date_format(moved, "yyyy-MM-dd"))
    )
    number = F.aggregate(F.split(value, "\\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    ip = F.transform(
        F.array(permuted_number(number, 65536, key, "ip")),
        lambda n: F.concat_ws(".", *[(F.shiftright(n, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)]),
    )[0]
    area = F.regexp_extract(value, r"^(\+?(?:[0-9]{1,3}[ .-](?=.{12,}))?)", 1)
    phone = F.concat(area, permuted_text(F.substring(value, F.length(area) + 1, F.length(value)), key, "phone"))
    plain = F.regexp_replace(value, "[ -]", "")  # equal values in other notations stay linked
    card = F.transform(
        F.array(permuted_text(F.substring(plain, F.lit(1), F.length(plain) - 1), key, "card")),
        lambda body: _with_separators(F.concat(body, ((10 - _luhn(body, 0) % 10) % 10).cast("string")), value),
    )[0]
    iban = F.transform(
        F.array(permuted_text(F.substring(plain, F.lit(5), F.length(plain)), key, "iban")),
        lambda body: _with_separators(F.concat(
            F.substring(value, 1, 2),
            F.lpad((98 - _mod97(F.concat(body, F.substring(value, 1, 2), F.lit("00")))).cast("string"), 2, "0"),
            body,
        ), value),
    )[0]
    account = F.transform(F.array(permuted_text(plain, key, "account")), lambda body: _with_separators(body, value))[0]
    return (
        F.when(kind == "email", email).when(kind == "date", date).when(kind == "ip", ip).when(kind == "phone", phone)
        .when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "ssn", permuted_text(value, key, "ssn")).when(kind == "account", account)
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal values in ``text`` replaced, and ``pii_kinds``, the kinds
    replaced in order of appearance.

    Null and empty texts stay; so do matches which do not validate.  No shuffle; texts
    without a digit or an at sign are not searched.  What follows an IBAN or a card in its
    match goes back to the text and is searched, unless the text holds the noncharacter
    ``STOP`` itself.  Other columns are returned as they were; if one is called
    ``pii_kinds``, the new column gets an underscore after its name.
    """
    work = [fresh(docs, f"_pii_{name}") for name in ("found", "values", "marked", "again", "text")]
    found_, values_, marked_, again_, text_ = work
    likely = F.col(text).rlike("[0-9@]")
    tried = docs.withColumn(found_, F.when(likely, F.regexp_extract_all(text, F.lit(ANY), 0)))
    # a match that begins with a shorter IBAN or card gets a mark there and the text is searched anew
    tried = tried.withColumn(marked_, F.when(~F.contains(text, F.lit(STOP)), F.transform(found_, _stopped)))
    marked = _all_stopped(F.col(text), 2 * F.size(found_))
    again = F.exists(marked_, lambda v: F.contains(v, F.lit(STOP)))
    tried = tried.withColumn(again_, F.coalesce(again, F.lit(False))).withColumn(text_, F.when(F.col(again_), marked).otherwise(F.col(text)))
    found = tried.withColumn(found_, F.when(F.col(again_), F.regexp_extract_all(text_, F.lit(ANY), 0)).otherwise(F.col(found_)))
    kinds = found.withColumn(
        values_, F.transform(found_, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))
    )
    changed = F.transform(values_, lambda x: pseudonym(x["v"], x["k"], key))
    joined = F.array_join(F.flatten(F.zip_with(
        F.split(F.col(text_), ANY), changed, lambda gap, value: F.array(gap, F.coalesce(value, F.lit("")))
    )), "")
    joined = F.when(F.col(again_), F.replace(joined, F.lit(STOP), F.lit(""))).otherwise(joined)
    done = kinds.withColumn(text, F.when(F.size(found_) > 0, joined).otherwise(F.col(text)))
    return done.withColumn(
        fresh(docs, "pii_kinds"), F.coalesce(F.filter(F.transform(values_, lambda x: x["k"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    ).drop(*work)

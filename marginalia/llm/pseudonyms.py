"""Format-preserving pseudonyms for personal numbers, dates and mail addresses, in SQL functions alone.

Candidates are found by one pattern and validated (check digit, ranges, calendar); what does not validate is left as it
is. A value becomes a list of components, each with a modulus; an alternating Feistel network adds keyed digests of
one half to the other half modulo those, which permutes the values of a format among themselves. So equal values get
equal pseudonyms in all documents, different values different ones, and only the key's owner can reverse them.

  card   13 to 19 digits with a valid check digit; the check digit is made anew. A card may begin and end at any border of
         digit groups within a longer run of digits, such as one with an expiry date or a number beside it; of those that
         overlap, the usual groupings come first, then the longer, then the earlier. What a run has besides cards is
         looked through for the other kinds
  phone  +1 (NXX) NXX-XXXX and its usual spellings; area and exchange keep a first digit of 2 to 9
  ssn    AAA-GG-SSSS with valid groups
  ip     four octets
  date   year, month, day with - / or . between, 1800 to 2199, as a real day; becomes another day of that range
  email  letters and digits of the local part; the domain stays

Edge cases: a null text stays null and an empty one empty, with counts 0; repeated rows are treated alike; candidates
that overlap tie in the order of the kinds' patterns; a very long text is searched whole, in time in proportion to its
length; columns of the input named like the counts give way; others pass through, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import col, table

KEY = "marginalia-demo-key"
ROUNDS = 8
#: Components that one digest moves, by 16 bits each.
DRAWN = 16
FIRST_YEAR = "1800-01-01"
#: 400 years of the calendar always have 146,097 days, which is 189 * 773.
DAY_MODULI = (189, 773)
FULL = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "date": r"\d{4}([-/.])\d{2}\1\d{2}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}",
    "card": r"\d(?:[ -]?\d){12,18}",
}
#: Groups of digits, none beside a letter; possessive, so that a run of any length needs no stack.
RUN = r"\d++(?!\w)(?:[ -]\d++(?!\w))*+"
#: For each group of a run, what of 13 to 19 digits begins there and ends with a group, as long as can be; else empty.
_FROM = r"(?<!\d)(?=(" + FULL["card"] + r"(?!\d))?)\d++"
_USUAL = r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
#: Stands for a card that was found in a run; a run has no letters.
_HELD = "C"
_PATTERNS = (
    [
        r"(?<![A-Za-z0-9._%+-])" + FULL["email"],
        r"(?<![\w.])" + FULL["ip"] + r"(?![\w]|\.\d)",
        r"(?<!\w)(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2})(?!\w)",
        r"(?<![\w-])" + FULL["ssn"] + r"(?![\w-])",
        r"(?<![\w+])" + FULL["phone"] + r"(?!\w)",
        r"(?<!\w)(?=\d(?:[ -]?\d){12})" + RUN,
    ]
)
_ANY = "|".join(_PATTERNS)
_IN_RUN = "|".join([_HELD, *_PATTERNS[:-1]])
KINDS = tuple(FULL)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)).cast("int"))


def _permuted(part: Column, modulus: Column, kind: str, key: str) -> Column:
    """A value alone has no second half: the values below the modulus, in the order of keyed digests."""
    drawn = F.transform(F.sequence(F.lit(0), modulus - 1), lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), modulus.cast("string"), i.cast("string")), 256).alias("d"), i.cast("int").alias("i")))
    return F.array(F.get(F.array_sort(drawn), part)["i"])


def feistel(parts: Column, moduli: Column, kind: str, key: str) -> Column:
    """parts: array of int, each below its modulus; returns such an array."""
    half = F.floor(F.size(parts) / 2).cast("int")
    rest = F.size(parts) - half

    def add(acc, r):
        seed = F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit(":"), F.array_join(acc["b"].cast("array<string>"), ","), F.lit(":"))
        digests = F.transform(F.sequence(F.lit(0), F.floor(F.size(acc["a"]) / DRAWN).cast("int")), lambda k: F.sha2(F.concat(seed, k.cast("string")), 256))
        drawn = lambda d, i: F.conv(F.substr(F.get(d, F.floor(i / DRAWN).cast("int")), F.pmod(i, F.lit(DRAWN)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        moved = _let(digests, lambda d: F.transform(acc["a"], lambda x, i: F.pmod(x + drawn(d, i), acc["ma"][i])))
        return F.struct(acc["b"].alias("a"), acc["mb"].alias("ma"), moved.alias("b"), acc["ma"].alias("mb"))

    start = F.struct(F.slice(parts, F.lit(1), half).alias("a"), F.slice(moduli, F.lit(1), half).alias("ma"), F.slice(parts, half + 1, rest).alias("b"), F.slice(moduli, half + 1, rest).alias("mb"))
    many = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, add, lambda acc: F.concat(acc["a"], acc["b"]))
    return F.when(F.size(parts) == 1, _permuted(parts[0], moduli[0], kind, key)).otherwise(many)


def _check_digit(payload: Column) -> Column:
    """Of an array of digits to which it will be appended."""
    doubled = F.transform(payload, lambda d, i: F.when((F.size(payload) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.pmod(10 - F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10, F.lit(10))


def _refill(value: Column, wanted: str, chars: Column) -> Column:
    """value, with its characters of the class ``wanted`` replaced in order by those of the array chars."""
    nth = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), f"[^{wanted}]", ""))
    one = lambda i: F.substr(value, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(one(i).rlike(f"[{wanted}]"), F.element_at(chars, F.greatest(nth(i), F.lit(1)))).otherwise(one(i))), "")


def _payload(v: Column) -> Column:
    return _digits(F.regexp_replace(F.substr(v, F.lit(1), F.length(v) - 1), "[ -]", ""))


def _valid_card(v: Column) -> Column:
    return _check_digit(_payload(v)) == F.right(v, F.lit(1)).cast("int")


def _card(v: Column, key: str) -> Column:
    payload = _payload(v)

    def made(p):
        return F.concat(p, F.array(_check_digit(p))).cast("array<string>")

    new = _let(feistel(payload, F.transform(payload, lambda _: F.lit(10)), "card", key), made)
    return F.when(_valid_card(v), _let(new, lambda n: _refill(v, "0-9", n)))


def _cards_of_run(run: Column) -> Column:
    """Array of struct(first, last, value) in order: the cards in a run of digits, with the groups they take."""

    def starting(window: Column, first: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(13), F.greatest(F.length(window), F.lit(13))), lambda n: ~F.substr(window, n, F.lit(2)).rlike(r"^(?:\d\d|[ -])"))
        tried = F.transform(ends, lambda n: F.substr(window, F.lit(1), n))
        good = F.filter(tried, lambda v: (F.length(v) >= 13) & (F.length(F.regexp_replace(v, "[ -]", "")) >= 13) & _valid_card(v))
        made = F.transform(good, lambda v: F.struct((~v.rlike(_USUAL)).alias("unusual"), (-F.length(v)).alias("less"), first.alias("first"), (first + F.size(F.split(v, "[ -]")) - 1).alias("last"), v.alias("value")))
        return made

    found = F.array_sort(F.flatten(F.transform(F.regexp_extract_all(run, F.lit(_FROM), 1), starting)))
    taken = lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["value"].alias("value"))
    none = F.array().cast("array<struct<first:int,last:int,value:string>>")
    free = lambda acc, x: F.forall(acc, lambda y: (x["last"] < y["first"]) | (x["first"] > y["last"]))
    return F.array_sort(F.aggregate(found, none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(taken(x)))).otherwise(acc)))


def _phone(v: Column, key: str) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    head = F.substr(digits, F.lit(1), F.length(digits) - 10)
    parts = F.transform(_digits(F.right(digits, F.lit(10))), lambda d, i: F.when(i.isin(0, 3), d - 2).otherwise(d))
    moduli = F.array(*[F.lit(8 if i in (0, 3) else 10) for i in range(10)])
    new = F.transform(feistel(parts, moduli, "phone", key), lambda d, i: F.when(i.isin(0, 3), d + 2).otherwise(d).cast("string"))
    return _let(F.concat(F.when(F.length(head) > 0, F.array(head)).otherwise(F.array().cast("array<string>")), new), lambda n: _refill(v, "0-9", n))


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substr(v, F.lit(a), F.lit(n)).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    parts = F.array(F.when(area > 666, area - 2).otherwise(area - 1).cast("int"), (group - 1).cast("int"), (serial - 1).cast("int"))
    new = feistel(parts, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)
    shown = lambda n: F.format_string("%03d-%02d-%04d", F.when(n[0] >= 665, n[0] + 2).otherwise(n[0] + 1), n[1] + 1, n[2] + 1)
    return F.when(valid, _let(new, shown))


def _ip(v: Column, key: str) -> Column:
    parts = F.split(v, r"\.").cast("array<int>")
    new = feistel(parts, F.array(*[F.lit(256)] * 4), "ip", key)
    return F.when(F.forall(parts, lambda x: x < 256), F.array_join(new.cast("array<string>"), "."))


def _date(v: Column, key: str) -> Column:
    mark = F.substr(v, F.lit(5), F.lit(1))
    day = F.try_to_timestamp(F.translate(v, "/.", "--"), F.lit("yyyy-MM-dd")).cast("date")
    n = F.datediff(day, F.lit(FIRST_YEAR).cast("date"))
    a, b = DAY_MODULI
    parts = F.array(F.floor(n / b).cast("int"), F.pmod(n, F.lit(b)))
    new = _let(feistel(parts, F.array(F.lit(a), F.lit(b)), "date", key), lambda p: F.date_format(F.date_add(F.lit(FIRST_YEAR).cast("date"), p[0] * b + p[1]), "yyyy-MM-dd"))
    # a leap day read leniently would come back as another day
    valid = (F.date_format(day, "yyyy-MM-dd") == F.translate(v, "/.", "--")) & n.between(0, a * b - 1)
    return F.when(valid, F.replace(new, F.lit("-"), mark))


def _email(v: Column, key: str) -> Column:
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    free = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    codes = F.transform(F.sequence(F.lit(1), F.length(free)), lambda i: F.ascii(F.substr(free, i, F.lit(1))))
    base = lambda c: F.when(c >= 97, F.lit(97)).when(c >= 65, F.lit(65)).otherwise(F.lit(48))
    parts, moduli = F.transform(codes, lambda c: c - base(c)), F.transform(codes, lambda c: F.when(c >= 65, F.lit(26)).otherwise(F.lit(10)))
    new = F.zip_with(feistel(parts, moduli, "email", key), codes, lambda p, c: F.char(p + base(c)))
    return F.concat(_let(new, lambda n: _refill(local, "A-Za-z0-9", n)), F.lit("@"), domain)


_MADE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _named(kind: str):
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def pseudonym(value: Column, key: str = KEY) -> Column:
    """struct(kind, value): of a candidate that validates its kind and pseudonym, else null and itself."""
    tried = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(KINDS):
        new = _let(_MADE[kind](value, key), _named(kind))
        tried = F.when(value.rlike(f"^(?:{FULL[kind]})$"), new).otherwise(tried)
    return F.coalesce(tried, _plain(value))


def _plain(value: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value"))


def _part(value: Column, plain: bool) -> Column:
    return F.struct(value.alias("value"), F.lit(plain).alias("plain"))


def _parts_of_run(run: Column) -> Column:
    """Array of struct(value, plain) that together are the run: candidates, and between them what is none."""

    def masked(b: Column) -> Column:
        def shown(group: Column, i: Column) -> Column:
            at = F.filter(b["cards"], lambda c: i.between(c["first"], c["last"]))
            after = F.coalesce(F.get(b["marks"], i), F.lit(""))
            return F.when(F.size(at) == 0, F.concat(group, after)).when(at[0]["last"] == i, F.concat(F.lit(_HELD), after)).otherwise("")

        held = F.array_join(F.transform(F.split(run, "[ -]"), shown), "")
        return _let(F.struct(held.alias("held"), b["cards"]["value"].alias("cards")), split_up)

    def split_up(b: Column) -> Column:
        found = F.struct(F.split(b["held"], _IN_RUN, -1).alias("gaps"), F.regexp_extract_all(b["held"], F.lit(_IN_RUN), 0).alias("found"), b["cards"].alias("cards"))
        return _let(found, alternating)

    def alternating(b: Column) -> Column:
        before = lambda i: F.size(F.filter(F.slice(b["found"], F.lit(1), i), lambda x: x == _HELD))
        parts = F.transform(b["found"], lambda v, i: F.array(_part(F.get(b["gaps"], i), True), _part(F.when(v == _HELD, F.get(b["cards"], before(i))).otherwise(v), False)))
        return F.concat(F.flatten(parts), F.array(_part(F.element_at(b["gaps"], -1), True)))

    return _let(F.struct(_cards_of_run(run).alias("cards"), F.regexp_extract_all(run, F.lit("[ -]"), 0).alias("marks")), masked)


def pseudonymize(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with the text replaced, and the number of values of each kind (n_card, n_phone, ...) and together."""
    counts = [*(f"n_{k}" for k in sorted(KINDS)), "n_values"]
    names = [c for c in docs.columns if c not in counts]
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*[col(c).alias(c) for c in names]).alias("row"), col(text).alias("text"))
    rows = rows.withColumn("found", F.when(F.col("text").rlike(_ANY), F.regexp_extract_all("text", F.lit(_ANY), 0)).otherwise(none))
    parts = lambda v: F.when(v.rlike(f"^{RUN}$") & v.rlike("(?:[0-9][ -]?){13}"), _parts_of_run(v)).otherwise(F.array(_part(v, False)))
    made = lambda x: F.when(x["plain"], _plain(x["value"])).otherwise(pseudonym(x["value"], key))
    rows = rows.withColumn("new", F.transform(F.coalesce("found", none), lambda v: F.transform(parts(v), made)))
    joined = F.array_join(F.transform(F.split("text", _ANY, -1), lambda gap, i: F.concat(gap, F.coalesce(F.array_join(F.get(F.col("new"), i)["value"], ""), F.lit("")))), "")
    shown = F.when(F.size("new") > 0, joined).otherwise(F.col("text")).alias(text)
    of = lambda k: F.size(F.filter(F.flatten("new"), lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}")
    total = F.size(F.filter(F.flatten("new"), lambda x: x["kind"].isNotNull())).cast("long").alias("n_values")
    return rows.select(*[shown if c == text else F.col("row")[c].alias(c) for c in names], *[of(k) for k in sorted(KINDS)], total)


def op4_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))

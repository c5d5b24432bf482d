"""PII surrogates, in DataFrame functions only.

Mentions are found by one alternation (e-mail addresses, keys and passwords, IBANs, cards, social security numbers,
phones, IP addresses, personal names of a lexicon). Each mention's canonical form (letter case and separators aside) is
hashed with a key; the surrogate pours the hash into the mention's own format: a digit for a digit, a letter of the
same case for a letter, separators, country code and top-level domain as they are, valid check digits (those of a card
where it had one), octets in range, a given name of the same gender and script with a family name of that script. The
same canonical form gives the same surrogate everywhere and in every format (coreference). All distinct forms of the
table are checked: one whose surrogate another form has, or that is itself a form in the table, draws again, and every
WIDEN draws the surrogate gets one more character, so that this ends with all surrogates distinct and none of them real.

Texts are matched once: documents with their mentions are written to the shared folder, and rewritten from there; only
where forms draw again are documents that hold them joined with the draws. The key is the session's setting
spark.tessera.pii.key; without it a constant one (tests), with which anyone could repeat the surrogates.

Cases: null text stays null, with no mentions; empty text stays empty; null doc_id is kept; repeated rows get equal
results; extra columns are kept by `rewrite`, also ones with the names used inside; an empty table gives an empty table; a text
may be of any length: no pattern repeats a group without bound or starts anew within a run of letters. Names outside the
lexicon are not found unless a title stands before them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, table

KEY, WIDEN = "surrogates-1", 24
NAMES = {
    ("latin", "f"): "Barbara Margaret Emma Olivia Sophia Isabella Charlotte Amelia Hannah Laura Julia Katharina Johanna Petra Sabine Monika Ursula Camille Isabelle Nathalie Sylvie Céline Hélène Elena Isabel Pilar Rosario Francesca Giulia Chiara Priya Ananya Fatima Aisha Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Nancy Maria Anna Claire Sophie Ingrid Greta Lucia Carmen".split(),
    ("latin", "m"): "Charles Christopher Matthew Anthony Andrew Joshua Kevin Brian George Edward Ronald Timothy Jason Jürgen Wolfgang Dieter Matthias Sebastian Laurent Olivier François Philippe Nicolas José Juan Luis Fernando Alejandro Pablo Giovanni Marco Luca Ahmed Mohammed Omar Rahul James John Robert Michael William David Richard Joseph Thomas Daniel Pierre Antoine Hans Klaus Stefan Carlos Miguel Javier".split(),
    ("cyrillic", "f"): "Юлия Екатерина Людмила Галина Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Павел Юрий Виктор Борис Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то".split(),
}
_ANY_NAME = "|".join(n for names in NAMES.values() for n in names)
TITLES = {"m": "Mr. Mr Herr Monsieur Señor Sr. господин".split(), "f": "Mrs. Mrs Ms. Ms Miss Frau Madame Mme Señora Sra. госпожа".split()}
_ANY_TITLE = "|".join(t.replace(".", r"\.") for titles in TITLES.values() for t in titles)
_FAMILY = r"\p{Lu}(?:['’]\p{Lu})?\p{L}*+(?:-\p{Lu}\p{L}*+)?"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: (type, pattern): the first that matches at a place wins.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|sk_live_|sk-|xox[bap]-)[A-Za-z0-9\-]{16,}"),
    ("password", r"(?:(?i)\b(?:password|passwd|pwd|secret|token|api_?key)\s?[=:]\s?\"?)[A-Za-z0-9+/_\-]{8,}\"?"),
    ("hex", r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z.+])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){3}|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5})(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,5}(?:[ .\-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9A-Za-z])"),
    ("ip", rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])"),
    ("person", rf"(?<!\p{{L}})(?:{_ANY_NAME}|{_ANY_TITLE}) {_FAMILY}(?!\p{{L}})"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What every mention holds; texts without it are passed over cheaply.
HINT = rf"[0-9@=:]|AKIA|gh[pousr]_|sk[_-]|xox[bap]-|[a-f]{{32}}|(?<!\p{{L}})(?:{_ANY_NAME}|{_ANY_TITLE}) \p{{Lu}}"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
WHOLE = {t: rf"^(?:{p})$" for t, p in PATTERNS}
WHOLE |= {"card": r"^[0-9][0-9 \-]{14,18}$", "phone": r"^[+(]?[0-9][0-9 ()+.\-]+$", "email": "@", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "hex": r"^[0-9a-f]+$", "secret": r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_|sk_live_|sk-|xox[bap]-)", "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$", "person": r"^\p{L}+\.? \p{Lu}[\p{L}'’\-]*$"}


def mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(m: Column) -> Column:
    order = ["email", "secret", "password", "ssn", "ip", "card", "hex", "iban", "phone", "person"]
    return reduce(lambda rest, t: F.when(m.rlike(WHOLE[t]), t).otherwise(rest), reversed(order), F.lit("other"))


def canonical(m: Column, t: Column) -> Column:
    return F.when(t == "email", F.lower(m)).when(t.isin("phone", "card", "ssn", "iban"), F.regexp_replace(m, "[^0-9A-Z+]", "")).when(t == "password", F.regexp_replace(m, r"^.*?[=:]\s?\"?|\"$", "")).otherwise(m)


def _stream(t: Column, c: Column, attempt: Column, key: str) -> Column:
    seed = F.concat_ws(":", F.lit(key), t, c, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))


def _byte(h: Column, k: Column) -> Column:
    return F.conv(F.substr(h, F.pmod(k, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pour(m: Column, h: Column, skip: Column, hexadecimal: Column, keep: Column | None = None) -> Column:
    """m with its alphanumerics after the first `skip` characters and the next `keep` alphanumerics drawn from the
    stream, class by class."""
    def step(s, x):
        c = x
        b = _byte(h, s["k"])
        draw = (
            F.when((s["k"] < 0) | ~c.rlike("[0-9A-Za-z]"), c)
            .when(hexadecimal & c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), b % 16 + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(F.lit(97) + b % 26))
            .otherwise(F.char(F.lit(65) + b % 26))
        )
        return F.struct(F.concat(s["out"], draw).alias("out"), (s["k"] + c.rlike("[0-9A-Za-z]").cast("int")).alias("k"))

    head, rest = F.substr(m, F.lit(1), skip), F.split(F.substr(m, skip + 1), "(?!^)")
    first = F.lit(0) if keep is None else -keep.cast("int")
    return F.concat(head, F.aggregate(rest, F.struct(F.lit("").alias("out"), first.alias("k")), step)["out"])


def _mod97(s: Column) -> Column:
    """Letters as 10 to 35; the whole number mod 97."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(s, "(?!^)(?!$)"), F.lit(0), lambda n, c: F.when(c.rlike("[0-9]"), n * 10 + value(c)).otherwise(n * 100 + value(c)) % 97)


def _iban(m: Column, h: Column) -> Column:
    """The country as it is, then check digits for the account that was drawn."""
    country, account = F.substr(m, F.lit(1), F.lit(2)), _pour(F.substr(m, F.lit(5)), h, F.lit(0), F.lit(False))
    check = F.lpad((F.lit(98) - _mod97(F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, account)


def _luhn(digits: Column) -> Column:
    """Sum of the digits with every second from the last but one doubled, mod 10."""
    n = F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)))
    return F.aggregate(F.transform(n, lambda d, i: F.when(i % 2 == 1, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.try_cast("int"))).otherwise(d.try_cast("int"))), F.lit(0), lambda a, b: a + b) % 10


def _checked(m: Column, drawn: Column) -> Column:
    """drawn with a last digit that makes it valid if m was."""
    only = lambda c: F.regexp_replace(c, "[^0-9]", "")
    zero = F.concat(F.regexp_replace(drawn, "[0-9]$", ""), F.lit("0"))
    return F.when(_luhn(only(m)) == 0, F.concat(F.regexp_replace(drawn, "[0-9]$", ""), ((F.lit(10) - _luhn(only(zero))) % 10).cast("string"))).otherwise(drawn)


def _person(m: Column, h: Column) -> Column:
    """A given name of the same gender and script, or the same title, and a family name of the script."""
    first = F.substring_index(m, " ", 1)
    family, of_title, given = {}, [], F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        part = F.array(*map(F.lit, syllables))
        family[script] = F.initcap(F.concat(*[F.get(part, _byte(h, F.lit(2 + i)) % len(syllables)) for i in range(4)]))
    for (script, gender), names in NAMES.items():
        ending = F.lit({"m": "ов", "f": "ова"}[gender] if script == "cyrillic" else "")
        given = F.when(first.isin(names), F.concat(F.get(F.array(*map(F.lit, names)), _byte(h, F.lit(0)) % len(names)), F.lit(" "), family[script], ending)).otherwise(given)
    for gender, titles in TITLES.items():
        of_title.append(F.when(first.isin(titles), F.concat(first, F.lit(" "), F.when(F.substring_index(m, " ", -1).rlike(r"^\p{IsCyrillic}"), F.concat(family["cyrillic"], F.lit({"m": "ов", "f": "ова"}[gender]))).otherwise(family["latin"]))))
    return F.coalesce(given, *of_title, m)


def surrogate(m: Column, t: Column, c: Column, attempt: Column, h: Column) -> Column:
    """The replacement of mention m of type t with canonical form c, from its stream h."""
    zero, no = F.lit(0), F.lit(False)
    domain = F.substring_index(m, ".", -1)
    octets = F.concat_ws(".", (_byte(h, F.lit(0)) % 223 + 1).cast("string"), *[_byte(h, F.lit(i)).cast("string") for i in (1, 2, 3)])
    value = F.length(F.regexp_extract(m, r"^.*?[=:]\s?\"?", 0))
    prefix = F.length(F.regexp_extract(m, r"^(?:AKIA|gh[pousr]_|sk_live_|sk-|xox[bap]-)", 0))
    country = F.greatest(F.length(F.regexp_extract(c, COUNTRY, 0)) - 1, zero)
    # draws beyond WIDEN: so many digits more than the format has
    wider = F.when(attempt >= WIDEN, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.floor(attempt / WIDEN), F.lit(1)).cast("int")), lambda k: (_byte(h, k + 60) % 10).cast("string")), "")).otherwise("")
    return (
        F.when(t == "email", F.concat(wider, _pour(F.substr(m, F.lit(1), F.length(m) - F.length(domain)), h, zero, no), domain))
        .when(t == "secret", F.concat(_pour(m, h, prefix, no), wider))
        .when(t == "password", F.concat(_pour(F.regexp_replace(m, '"$', ""), h, value, F.substr(m, value + 1).rlike('^[0-9a-f]+"?$')), wider, F.when(m.endswith('"'), '"').otherwise("")))
        .when(t == "hex", F.concat(_pour(m, h, zero, F.lit(True)), wider))
        .when(t == "iban", _iban(F.concat(m, wider), h))
        .when(t == "card", F.concat(_checked(m, _pour(m, h, zero, no)), wider))
        .when(t == "phone", F.concat(_pour(m, h, zero, no, country), wider))
        .when(t == "ip", F.concat(octets, wider))
        .when(t == "person", F.concat(_person(m, h), wider))
        .otherwise(F.concat(_pour(m, h, zero, no), wider))
    )


def _with(e: Column, attempt: Column, key: str) -> Column:
    """A mention's struct (m, t, c) with its attempt and stream, each evaluated once."""
    return F.struct(e["m"].alias("m"), e["t"].alias("t"), e["c"].alias("c"), attempt.alias("a"), _stream(e["t"], e["c"], attempt, key).alias("h"))


def draws(forms: DataFrame, key: str = KEY) -> DataFrame | None:
    """(t, c, attempt) of the forms (t, c, m) that must draw again for all surrogates to be distinct; None: no form."""

    def drawn(rows):
        rows = rows.withColumn("h", _stream(F.col("t"), F.col("c"), F.col("attempt"), key))
        got = surrogate(F.col("m"), F.col("t"), F.col("c"), F.col("attempt"), F.col("h"))
        return materialize(rows.withColumn("s", got).drop("h").withColumn("s", canonical(F.col("s"), F.col("t"))), "surrogates")

    now, again = drawn(forms.withColumn("attempt", F.lit(0))), None
    while True:
        shared = now.groupBy("t", "s").agg(F.count("*").alias("n"), F.min("c").alias("owner")).where("n > 1")
        real = now.select("t", F.col("c").alias("s"), F.lit(True).alias("real"))
        clash = now.join(shared, ["t", "s"], "left").join(real, ["t", "s"], "left").where("n > 1 and c <> owner or real").select("t", "c", F.lit(True).alias("clash"))
        if not clash.head(1):
            if again is None:
                discard(now)
                return None
            return again.where("attempt > 0").select("t", "c", "attempt")
        attempt = F.col("attempt") + F.coalesce(F.col("clash"), F.lit(False)).cast("int")
        older, now = now, drawn(now.join(clash, ["t", "c"], "left").withColumn("attempt", attempt).select("t", "c", "m", "attempt"))
        again = now
        discard(older)


def _rewritten(docs: DataFrame, key: str | None) -> DataFrame:
    """docs as one struct `given`, with `body`, the text with surrogates, and `types`."""
    key = key or docs.sparkSession.conf.get("spark.tessera.pii.key", KEY)
    text = F.col("given.text").cast("string")
    found = docs.select(F.struct("*").alias("given")).withColumn("found", mentions(text))
    found = found.withColumn("found", F.transform("found", lambda m: F.struct(m.alias("m"), kind(m).alias("t"))))
    typed = lambda e: F.struct(e["m"].alias("m"), e["t"].alias("t"), canonical(e["m"], e["t"]).alias("c"))
    base = materialize(found.withColumn("found", F.transform("found", typed)), "mentions")
    each = base.select(F.explode("found").alias("e"))
    again = draws(each.groupBy("e.t", "e.c").agg(F.min("e.m").alias("m")), key)
    if again is None:
        base = base.withColumn("tries", F.lit(None).cast("map<string,int>"))
    else:
        rows = base.withColumn("row", F.struct(F.xxhash64("given.doc_id", text), F.length(text)))
        asked = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("e")).select("row", "e.t", "e.c").distinct()
        tries = asked.join(again, ["t", "c"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "t", "c"), "attempt"))).alias("tries"))
        base = rows.join(tries, "row", "left")
    tried = lambda e: F.coalesce(F.try_element_at("tries", F.concat_ws(":", e["t"], e["c"])), F.lit(0))
    ready = F.transform("found", lambda e: _with(e, tried(e), key))
    put = F.transform(ready, lambda e: surrogate(e["m"], e["t"], e["c"], e["a"], e["h"]))
    woven = F.array_join(F.flatten(F.zip_with(F.split(text, PATTERN, -1), put, lambda gap, s: F.array(gap, F.coalesce(s, F.lit(""))))), "")
    return base.select("given", F.when(F.size("found") > 0, woven).otherwise(text).alias("body"), F.transform("found", lambda e: e["t"]).alias("types"))


def rewrite(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with surrogates in its text."""
    columns = [F.col("body").alias("text") if c == "text" else F.col("given")[c].alias(c) for c in docs.columns]
    return _rewritten(docs, key).select(*columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _rewritten(table(spark, sf_dir, "documents"), None)
    return done.select("given.doc_id", F.col("body").alias("text"), F.size("types").cast("long").alias("n_replaced"), F.array_sort(F.array_distinct("types")).alias("types"))

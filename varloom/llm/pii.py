"""Personal data replaced by surrogates.

Entities are e-mail addresses, phone numbers, payment cards (Luhn), IPv4 and IPv6 addresses, social security numbers, IBANs (mod 97) and
names after a title. National numbers that begin with 0 count after a word for telephone only. A mention is cut into units with a canonical value each: an address into its local part and its domain, a name into its
words, a number into its digits. Every distinct value gets one surrogate in the whole corpus, drawn from a keyed hash, so that mentions
of one entity stay mentions of one entity, whatever their punctuation or case.

Surrogates keep type and format: digits for digits and letters for letters, the separators, case, country code, card scheme and top-level
domain; check digits are valid again. Surrogates of names keep the script and, by their ending, the gender of the title. Within a
document that has a title's name, its words are replaced wherever else they stand between the mentions, the longest first; a word that
the document also holds in lower case is a common one ("Will", "May"), and replaced in the mentions only.

The secret keys the surrogates: who has it can tell the surrogate of a guessed value. It is a parameter without a default; the registered
query takes it from the setting spark.varloom.pii.secret, and a published one for its tests where that is unset.

Collisions are checked in rounds over the table of distinct values: proposals that equal a value of the corpus, a settled surrogate or
another proposal (the smallest value wins) are drawn again. From round EXTRA on surrogates grow by a character for every EXTRA rounds
and may equal corpus values, so that a format whose space is used up still ends with distinct surrogates. Only values, counted on the
map side, and the texts that have mentions are shuffled.

Edge cases: a null text stays null and an empty one empty, without entities; repeated rows get equal results; a null id is an id like
others; card-like or IBAN-like numbers with wrong check digits stay; an empty table gives an empty result; extra columns are carried
along, and columns named as the counts are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import release, shared_folder, written

#: Titles by the gender they tell.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "госпожа", "Госпожа", "κυρία", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "Господин", "κύριος", "Κύριος"),
    "x": ("Dr", "Prof"),
}
_title = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_word = r"\p{Lu}[\p{L}'’-]*\p{L}"
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_hex = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,30}[A-Za-z]{2,24}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\w)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])(?:1[ .-])?(?:\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4})(?![\w-])|(?<![\w.-])1[ .-]\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])"
    r"|(?=0)(?<=(?i:tel|phone|telefon|telephone|teléfono|téléphone|fax|mobile|mobil|handy)[.:]{0,2} )0\d{1,4}[ /-]\d{4,9}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.]){_octet}(?:\.{_octet}){{3}}(?!\w|\.\d)|(?<![\w:.])(?:(?:{_hex}:){{7}}{_hex}|(?:{_hex}:){{2,6}}(?::{_hex}){{1,5}})(?![\w:])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "name": rf"(?<![\p{{L}}]){_title} {_word}(?: {_word}){{0,4}}(?!\p{{L}})",
}
KINDS = tuple(PATTERNS)
#: All but addresses begin with one of few characters, and an address has an @: a text without one needs no look at every word.
OTHERS = r"(?=[\p{Lu}\d(+гκ]|[a-f][0-9A-Fa-f]{0,3}:)(?:" + "|".join(v for k, v in PATTERNS.items() if k != "email") + ")"
PATTERN = PATTERNS["email"] + "|" + OTHERS
#: Country calling codes of one and two digits; all others have three.
CALLING = r"1|7|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
EXTRA = 16
#: The setting that keys the registered query, and its key where that is unset: published, so for tests only.
SETTING, PUBLISHED = "spark.varloom.pii.secret", "a published key for tests"
HEX, CONSONANTS, VOWELS = "0123456789abcdef", "bdfgklmnprstvzhj", "aeiouaeiouaeioua"
SCRIPTS = {"cyrillic": ("bdfgklmnprstvzhjaeiou", "бдфгклмнпрствзхжаеиоу"), "greek": ("bdfgklmnprstvzhjaeiou", "βδφγκλμνπρστψζχξαειου")}
UNIT = "array<struct<kind:string,pre:string,k:string,g:string,scope:string,c:string,f:string>>"


# Expressions ----------------------------------------------------------------------------------------------------------------


def cases(pairs, otherwise: Column) -> Column:
    return reduce(lambda rest, pair: F.when(pair[0], pair[1]).otherwise(rest), reversed(list(pairs)), otherwise)


def chars(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def luhn_sum(x: Column) -> Column:
    """Of a string of digits, the last one the check digit."""
    n = F.length(x)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(x, n - i + 1, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(iban: Column) -> Column:
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(chars(moved), F.lit(0), lambda a, x: F.when(F.ascii(x) < 58, a * 10 + F.ascii(x) - 48).otherwise(a * 100 + F.ascii(x) - 55) % 97)


def kind_of(m: Column) -> Column:
    """A mention's kind; null if its check digits are wrong."""
    return cases(
        [
            (F.contains(m, F.lit("@")), F.lit("email")),
            (m.rlike(r"^[A-Z]{2}\d{2}"), F.when(mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1, "iban")),
            (F.contains(m, F.lit(":")), F.lit("ip")),
            (m.rlike(r"^\p{L}"), F.lit("name")),
            (m.rlike(r"^[+(]|^(1[ .-])?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$|^0\d{1,4}[ /-]\d{4,9}$"), F.lit("phone")),
            (m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn")),
            (m.rlike(r"^\d+(\.\d+){3}$"), F.lit("ip")),
        ],
        F.when(luhn_sum(digits_of(m)) % 10 == 0, "card"),
    )


def unit(kind, pre: Column, k, g, scope, c: Column, f: Column) -> Column:
    values = {"kind": kind, "pre": pre, "k": k, "g": g, "scope": scope, "c": c, "f": f}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(n) for n, v in values.items()])


def units_of(pre: Column, m: Column, kind: Column) -> Column:
    """The units of a mention after the text pre. kind: of the first unit; k, g: kinds of value, g those that share surrogates; scope:
    within which they are distinct; c: the canonical value; f: its form here."""
    domain = F.substring_index(m, "@", -1)
    email = F.array(unit("email", pre, "email", "email", F.lower(domain), F.lower(m), F.substring_index(m, "@", 1)), unit(None, F.lit("@"), "domain", "domain", "", F.lower(domain), domain))
    title = F.regexp_extract(m, f"^{_title} ", 0)
    words = F.split(F.substring(m, F.length(title) + 1, F.length(m)), " ")
    bare = F.regexp_replace(title, r"[. ]+$", "")
    gender = F.when(bare.isin(*TITLES["f"]), "f").when(bare.isin(*TITLES["m"]), "m").otherwise("x")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def name(w: Column, i: Column) -> Column:
        k = F.when(i == F.size(words) - 1, "family").otherwise(F.concat(F.lit("given_"), gender))
        return unit(F.when(i == 0, "name"), F.when(i == 0, F.concat(pre, title)).otherwise(F.lit(" ")), k, "name", script(w), F.lower(w), w)

    phone = F.concat(F.when(m.rlike(r"^[+0]|^1[ .-]"), F.lit("+")).otherwise(F.lit("+1")), digits_of(m))
    canonical = F.when(kind == "phone", phone).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "ip", F.lower(m)).otherwise(digits_of(m))
    return (
        F.when(kind.isNull(), F.array(unit(None, F.concat(pre, m), None, None, None, F.lit(None), F.lit(""))))
        .when(kind == "email", email)
        .when(kind == "name", F.transform(words, name))
        .otherwise(F.array(unit(kind, pre, kind, kind, "", canonical, m)))
        .cast(UNIT)
    )


def proposal(round_: int) -> Column:
    """The surrogate of a value (k, scope, c) in a round, from _pi_h, 128 hexadecimal digits, and _pi_d, 120 decimal ones."""
    k, c, h, d = F.col("k"), F.col("c"), F.col("_pi_h"), F.col("_pi_d")
    more = round_ // EXTRA
    draw = lambda n: F.substring(d, F.lit(1), n)
    letter = lambda i: F.when(i % 2 == 0, F.translate(F.substring(h, i % 128 + 1, F.lit(1)), HEX, CONSONANTS)).otherwise(F.translate(F.substring(h, i % 128 + 1, F.lit(1)), HEX, VOWELS))

    def shaped(x: Column) -> Column:
        new = F.transform(chars(x), lambda ch, i: F.when(ch.rlike(r"\d"), F.substring(d, i % 120 + 1, F.lit(1))).when(ch.rlike("[a-z]"), letter(i)).when(ch.rlike("[A-Z]"), F.upper(letter(i))).otherwise(ch))
        return F.concat(F.array_join(new, ""), F.substring(h, 100, more) if more else F.lit(""))

    calling = F.regexp_extract(c, rf"^\+({CALLING})", 1)
    rest = F.length(c) - 1 - F.length(calling) + more
    phone = F.concat(F.lit("+"), calling, F.translate(F.substring(d, 1, 1), "01", "28"), F.substring(d, F.lit(2), rest - 1))
    body = F.concat(F.substring(c, 1, 1), draw(F.length(c) - 2 + more))
    card = F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    octets = F.transform(F.sequence(F.lit(0), F.lit(3 + more)), lambda i: (F.conv(F.substring(h, 8 * (i % 16) + 1, F.lit(8)), 16, 10).cast("long") % 254 + 1).cast("string"))
    six = F.array_join(F.transform(chars(c), lambda ch, i: F.when(ch == ":", ch).otherwise(F.substring(h, i % 128 + 1, F.lit(1)))), "")
    six = F.concat(six, F.substring(h, 100, more)) if more else six
    bank = F.upper(shaped(F.substring(c, F.lit(5), F.length(c))))
    iban = F.concat(F.substring(c, 1, 2), F.lpad((98 - mod97(F.concat(F.substring(c, 1, 2), F.lit("00"), bank))).cast("string"), 2, "0"), bank)
    top = F.substring_index(c, ".", -1)
    domain = F.concat(shaped(F.substring(c, F.lit(1), F.length(c) - F.length(top) - 1)), F.lit("."), top)
    syllables = F.least(F.greatest(F.ceil(F.length(c) / 2).cast("int") - 1, F.lit(2)), F.lit(4)) + round_ // 4
    stem = F.array_join(F.transform(F.sequence(F.lit(0), 2 * syllables - 1), letter), "")
    last = F.substring(h, 127, 1)
    ending = F.when(k == "given_f", F.translate(last, HEX, "nlrsnlrsnlrsnlrs")).when(k == "given_m", F.translate(last, HEX, "nrksnrksnrksnrks")).when(k == "given_x", "li").otherwise("")
    ending = F.when(k == "given_f", F.concat(ending, F.lit("a"))).otherwise(ending)
    name = F.concat(stem, ending)
    for script, (latin, own) in SCRIPTS.items():
        name = F.when(F.col("scope") == script, F.translate(F.concat(stem, ending), latin, own)).otherwise(name)
    return cases(
        [(k == "email", shaped(F.substring_index(c, "@", 1))), (k == "domain", domain), (k == "phone", phone), (k == "card", card), (k == "ssn", draw(F.lit(9 + more))), ((k == "ip") & F.contains(c, F.lit(":")), six), (k == "ip", F.array_join(octets, ".")), (k == "iban", iban)],
        name,
    )


def rendered() -> Column:
    """The surrogate s in the form f: separators and case as they were."""
    k, c, f, s = (F.col(x) for x in ("k", "c", "f", "s"))

    def filled(digits: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
        step = lambda a, ch: F.when(ch.rlike("[A-Z0-9]"), F.struct(F.concat(a["out"], F.substring(digits, a["i"], F.lit(1))).alias("out"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["out"], ch).alias("out"), a["i"].alias("i")))
        return F.aggregate(chars(f), start, step, lambda a: F.concat(a["out"], F.substring(digits, a["i"], F.length(digits))))

    skipped = F.length(digits_of(c)) - F.length(digits_of(f))
    first = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
    upper = (F.upper(f) == f) & (F.lower(f) != f) & (F.length(f) > 1)
    return cases(
        [
            (k == "phone", filled(F.substring(digits_of(s), skipped + 1, F.length(s)))),
            (k.isin("card", "ssn", "iban"), filled(s)),
            (k == "ip", s),
            (upper, F.upper(s)),
            (f.rlike(r"^\p{Lu}"), first),
        ],
        s,
    )


# Surrogates -----------------------------------------------------------------------------------------------------------------


def surrogates(values: DataFrame, folder: str, secret: str) -> DataFrame:
    """values: k, g, scope, c. Gives each distinct one its s, distinct within g and scope, after as many rounds as collisions need."""
    spark = values.sparkSession
    same, place = ["k", "g", "scope", "c"], ["g", "scope", "s"]
    values = written(values.select(*same).distinct(), f"{folder}/values")
    todo, settled, k = values, None, 0
    while True:
        h = F.sha2(F.concat_ws("\u001f", F.lit(secret), "k", "c", F.lit(str(k))), 512)
        tens = F.concat(*[F.right(F.lpad(F.conv(F.substring("_pi_h", 1 + 15 * i, 15), 16, 10), 18, "0"), F.lit(15)) for i in range(8)])
        free = todo.withColumn("_pi_h", h).withColumn("_pi_d", tens).withColumn("s", proposal(k)).drop("_pi_h", "_pi_d")
        if k < EXTRA:
            taken = values.select("g", "scope", F.when(F.col("g") == "email", F.substring_index("c", "@", 1)).otherwise(F.col("c")).alias("s"))
            free = free.join(taken, place, "left_anti")
        if settled is not None:
            free = free.join(settled, place, "left_anti")
        won = free.groupBy(*place).agg(F.min(F.struct("c", "k")).alias("x")).select("x.k", "g", "scope", "x.c", "s")
        won = written(won, f"{folder}/settled-{k}")
        settled = won if settled is None else settled.unionByName(won)
        todo = written(todo.join(won, same, "left_anti"), f"{folder}/todo-{k}")
        release(spark)
        if todo.isEmpty():
            return settled.select("k", "scope", "c", "s")
        k += 1


def pseudonymise(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rewritten, and n_email, n_iban, ... and n_entities: mentions by kind and in all."""
    if not secret:
        raise ValueError("surrogates need a secret")
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in (*counts, "n_entities")]
    text = F.col(f"`{text_col}`")
    with_any = F.coalesce(F.when(F.contains(text, F.lit("@")), text.rlike(PATTERN)).otherwise(text.rlike(OTHERS)), F.lit(False))
    kinds = F.transform("_pi_m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    found = (
        docs.filter(with_any)
        .select(*columns, F.xxhash64(f"`{id_col}`", text).alias("_pi_a"), F.xxhash64(text, F.lit(1), f"`{id_col}`").alias("_pi_b"))
        .withColumns({"_pi_m": F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), "_pi_p": F.split(text, PATTERN, -1)})
        .withColumn("_pi_m", kinds)
        .withColumn("_pi_u", F.flatten(F.transform("_pi_m", lambda m, i: units_of(F.get("_pi_p", i), m["m"], m["kind"]))))
        .withColumn("_pi_tail", F.element_at("_pi_p", -1))
        .drop("_pi_m", "_pi_p")
    )
    found = written(found, f"{folder}/found")
    key = ["_pi_a", "_pi_b"]
    units = found.dropDuplicates(key).select(*key, F.posexplode("_pi_u").alias("pos", "u")).select(*key, "pos", "u.k", "u.g", "u.scope", "u.c", "u.f")
    mapping = surrogates(found.select(F.explode("_pi_u").alias("u")).filter("u.k IS NOT NULL").select("u.k", "u.g", "u.scope", "u.c"), folder, secret)
    new = units.filter("k IS NOT NULL").join(mapping, ["k", "scope", "c"]).select(*key, "pos", "g", "f", rendered().alias("r"))
    new = new.unionByName(units.filter("k IS NULL").select(*key, "pos", "g", "f", F.lit("").alias("r")))
    by_text = new.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("_pi_r"), F.sort_array(F.collect_set(F.when(F.col("g") == "name", F.struct((-F.length("f")).alias("n"), "f", "r")))).alias("_pi_names"))
    # Names are replaced in the source's text between the mentions; what a mention became is not looked at again.
    between = F.array_join(F.concat(F.transform("_pi_u", lambda u: u["pre"]), F.array("_pi_tail")), "\n")
    alone = lambda w: F.concat(F.lit(r"(?<!\p{L})\Q"), w, F.lit(r"\E(?!\p{L})"))
    common = lambda x: (F.lower(x["f"]) != x["f"]) & F.regexp("_pi_between", alone(F.lower(x["f"])))
    elsewhere = lambda t, x: F.regexp_replace(t, alone(x["f"]), x["r"])
    names = lambda t: F.aggregate("_pi_names", t, elsewhere)
    # A mention's title is part of what stands before its first word: it is no name.
    joined = F.zip_with("_pi_u", "_pi_r", lambda u, r: F.concat(names(u["pre"]), r["r"]))
    new_text = F.concat(F.array_join(joined, ""), names(F.col("_pi_tail")))
    count = lambda k: F.size(F.filter("_pi_u", lambda u: u["kind"] == k)).cast("long")
    total = reduce(lambda a, b: a + b, [F.col(c) for c in counts])
    changed = (
        found.join(by_text, key)
        .withColumn("_pi_between", F.when(F.size("_pi_names") > 0, between))
        .withColumn("_pi_names", F.filter("_pi_names", lambda x: ~common(x)))
        .withColumn(text_col, new_text)
        .withColumns({f"n_{k}": count(k) for k in KINDS})
        .select(*columns, *counts, total.alias("n_entities"))
    )
    clean = docs.filter(~with_any).select(*columns, *[F.lit(0).cast("long").alias(c) for c in (*counts, "n_entities")])
    return clean.unionByName(changed)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, spark.conf.get(SETTING, None) or PUBLISHED)
    return out.select("doc_id", "n_entities", *[f"n_{k}" for k in KINDS], "text")

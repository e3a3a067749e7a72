"""Surrogates for personal data, in DataFrame functions only (operator 1).

Detected: e-mail addresses, IPv4 addresses, phone numbers, card numbers (13 to 19 digits),
identity numbers of the form 3-2-4, hexadecimal secrets of 32 to 64 digits, access key ids, what
follows ``password=``, and names after a title that shows the gender. Every entity gets a keyed surrogate of its own type:

* same length, separators and letter case; digits stay digits, letters letters;
* e-mail: the last domain label stays; phone: the country code stays, an area code starts
  with 2 to 9; IPv4: valid octets of the same widths; card: first digit and Luhn validity
  stay; secret: hexadecimal; access key id: its four-letter mark stays; password: the word before
  it stays, and a hexadecimal one stays hexadecimal;
* name: the title stays, vowels become vowels and consonants consonants of the same script
  (Latin, Cyrillic, Greek), and the end follows the gender (an open vowel after a feminine
  title, a consonant after a masculine one).

The same entity gets the same surrogate in every document, also in another format (the digits
of a phone or card number, the lower-cased address, the name without its title count): the
surrogate depends on the key and this identity only. Distinctness is checked over the corpus:
the table of distinct entities (a partial aggregate, so a hot entity collapses before the
shuffle) is searched for two entities with one surrogate and for surrogates that are
themselves entities of the corpus; those, but for one owner, are keyed anew until none is left. After
``SAME_SPACE`` attempts the space of the surrogates grows with every attempt, so this ends whatever the
number of entities: a name gets syllables, an address, secret or password letters, a number digits, an
IPv4 address three-digit octets and later the form of an IPv6 address. Only
the few entities with a later key are joined to the texts, by a hash of the text; all others
are replaced inside the scan, and the documents are not shuffled for them.

Defined results: null text stays null, with no entities; a text without entities stays as it is.
Every input row gives one row; its other columns stay, but for old columns named like the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, saved

KEY = "surrogate-key-1"

MASCULINE = "Mr|Mister|Herr|Monsieur|Señor|Signor|Г-н|Господин|Κύριος"
FEMININE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Signora|Г-жа|Госпожа|Κυρία"
TITLE = rf"(?:{FEMININE}|{MASCULINE})\.? "
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,7}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
IPV4 = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])"
ACCESS = r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
LABEL = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd) ?[=:] ?"
PASSWORD = rf"(?<![0-9A-Za-z]){LABEL}[^\s\"',;]{{3,127}}[^\s\"',;.!?]"
# the groups of a number end where an address begins
PHONE = (r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
         rf"|(?<![0-9+])\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?(?!{OCTET}(?:\.{OCTET}){{3}})[0-9]{{2,4}}){{1,3}}(?![0-9])"
         r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?![0-9])")
IDENT = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9A-Za-z.])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{13,19}+(?![0-9A-Za-z])"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}\p{{Lu}}\p{{L}}+(?:['’-]\p{{L}}+)*(?: \p{{Lu}}\p{{L}}+(?:['’-]\p{{L}}+)*)?"
#: A look-ahead on the first character keeps the regex from trying the longer alternatives at every position.
PATTERN = "|".join((f"(?=[Pp])(?:{PASSWORD})", EMAIL, SECRET, f"(?=[0-9+(])(?:{IPV4}|{PHONE}|{IDENT}|{CARD})", f"(?=A)(?:{ACCESS})", f"(?=[MHFSГΚ])(?:{NAME})"))

#: Letters of surrogate names by script: vowels, consonants, feminine end, masculine end.
SCRIPTS = {"latin": ("aeiou", "bcdfghklmnprstvz", "a", "nrstlmk"), "cyrillic": ("аеиоу", "бвгдзклмнпрст", "а", "нрстлмк"), "greek": ("αεηιο", "βγδζκλμνπρστ", "α", "ς")}
#: Attempts with surrogates of the entity's own length; each later one has longer surrogates.
SAME_SPACE = 4
WIDE_IP = 4  # attempts with three-digit octets, before the form of an IPv6 address
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿаеёиоуыэюяαεηιουωάέήίόύώ"


def _char(s: Column, i: Column) -> Column:
    return F.substr(s, i, F.lit(1))


def _pick(letters: str | Column, r: Column) -> Column:
    s = F.lit(letters) if isinstance(letters, str) else letters
    return _char(s, (r % F.length(s) + 1).cast("int"))


def typed(m: Column) -> Column:
    """``(m, kind)`` of a match."""
    kind = (F.when(m.rlike("^" + LABEL), "password").when(m.rlike(f"^{ACCESS}$"), "access").when(m.contains("@"), "email").when(m.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$"), "ip").when(m.rlike("^[0-9a-f]{32,64}$"), "secret")
            .when(m.rlike(r"^\p{L}"), "name").when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ident").when(m.rlike(r"^\+|^\(|^[0-9]{3}[.-][0-9]{3}[.-]"), "phone").otherwise("card"))
    return F.struct(m.alias("m"), kind.alias("kind"))


def identified(s: Column) -> Column:
    """``(m, kind, canon)``: canon is what makes two mentions the same entity."""
    m, kind = s["m"], s["kind"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.when(m.startswith("+"), F.greatest(F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1)), F.lit(1))).otherwise(0)
    gender = F.when(m.rlike(rf"^(?:{FEMININE})\.? "), "f").otherwise("m")
    canon = (F.when(kind == "email", F.lower(m)).when(kind == "phone", F.concat(code.cast("string"), F.lit("|"), digits))
             .when(kind.isin("card", "ident"), digits).when(kind == "name", F.concat(gender, F.lit("|"), F.lower(F.regexp_replace(m, "^" + TITLE, ""))))
             .when(kind == "password", F.regexp_replace(m, "^" + LABEL, "")).otherwise(m))
    return F.struct(m.alias("m"), kind.alias("kind"), canon.alias("canon"))


def slotted(s: Column) -> Column:
    """Adds ``slots``, the letters and digits that are replaced one by one, and ``n_head``/``n_tail`` that stay."""
    kind, canon = s["kind"], s["canon"]
    slots = F.when(kind.isin("phone", "name"), F.regexp_replace(F.regexp_replace(canon, r"^[^|]*\|", ""), r"[^\p{L}0-9]", "")).otherwise(F.regexp_replace(canon, "[^A-Za-z0-9]", ""))
    head = F.when(kind == "phone", F.regexp_extract(canon, r"^([0-9]+)\|", 1).cast("int")).when(kind == "card", 1).when(kind == "access", 4).otherwise(0)
    tail = F.when(kind == "email", F.length(F.regexp_extract(canon, r"\.([^.]*)$", 1))).otherwise(0)
    return F.struct(*[s[c].alias(c) for c in ("m", "kind", "canon")], slots.alias("slots"), head.alias("n_head"), tail.alias("n_tail"))


def widened(s: Column, attempt: Column) -> Column:
    """The slots of an attempt: longer ones from ``SAME_SPACE`` on, so that the space of surrogates grows."""
    kind, slots, more = s["kind"], s["slots"], (attempt - (SAME_SPACE - 1)).cast("int")
    longer = (F.when(kind == "email", F.concat(F.repeat(F.lit("ba"), more), slots))
              # an even number of zeros behind the first digit keeps the Luhn sum
              .when(kind == "card", F.concat(F.substr(slots, F.lit(1), F.lit(1)), F.repeat(F.lit("00"), more), F.substr(slots, F.lit(2))))
              .when(kind.isin("phone", "ident"), F.concat(slots, F.repeat(F.lit("0"), more)))
              .when(kind == "ip", F.when(more > WIDE_IP, "0" * 32).otherwise("0" * 12))
              .otherwise(F.concat(slots, F.repeat(F.lit("ba"), more))))
    return F.when(attempt < SAME_SPACE, slots).otherwise(longer)


def keyed(s: Column, attempt: Column, key: str) -> Column:
    """``slots`` of the attempt, and ``noise``: four hexadecimal digits a slot from SHA-512 of key, type, identity and attempt."""
    s = F.struct(*[s[c].alias(c) for c in ("m", "kind", "canon")], widened(s, attempt).alias("slots"), *[s[c].alias(c) for c in ("n_head", "n_tail")])
    block = lambda b: F.sha2(F.concat_ws("|", F.lit(key), s["kind"], s["canon"], attempt.cast("string"), b.cast("string")), 512)
    noise = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(s["slots"]) / 32).cast("int")), block), "")
    return F.struct(*[s[c].alias(c) for c in ("m", "kind", "canon", "slots", "n_head", "n_tail")], noise.alias("noise"))


def luhn(body: Column) -> Column:
    """The check digit of a digit string."""
    def add(total, i):
        d = _char(body, F.length(body) - i + 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)
    return (10 - total % 10) % 10


def replaced(s: Column) -> Column:
    """``(m, kind, canon, slots, body, noise)``: body holds the replaced slots (a card's last digit still to come)."""
    kind, slots, noise = s["kind"], s["slots"], s["noise"]
    n = F.length(slots)

    def rnd(i):
        return F.conv(F.substr(noise, ((i - 1) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")

    script = F.when(slots.rlike(r"\p{IsCyrillic}"), "cyrillic").when(slots.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def of_script(place):
        out = F.lit(SCRIPTS["latin"][place])
        return F.when(script == "cyrillic", SCRIPTS["cyrillic"][place]).when(script == "greek", SCRIPTS["greek"][place]).otherwise(out)

    def one(i):
        c, r = _char(slots, i), rnd(i)
        digit = c.rlike("[0-9]")
        name = F.when(i == n, F.when(s["canon"].startswith("f|"), _pick(of_script(2), r)).otherwise(_pick(of_script(3), r))).otherwise(
            F.when(F.instr(F.lit(VOWELS), c) > 0, _pick(of_script(0), r)).otherwise(_pick(of_script(1), r)))
        return (F.when((i <= s["n_head"]) | (i > n - s["n_tail"]), c)
                .when(kind == "name", name)
                .when((kind == "phone") & (i == s["n_head"] + 1), (r % 8 + 2).cast("string"))
                .when(digit, (r % 10).cast("string"))
                .when((kind == "secret") | ((kind == "password") & slots.rlike("^[0-9a-f]+$")), _pick("abcdef", r))
                .otherwise(_pick("abcdefghijklmnopqrstuvwxyz", r)))

    octets = F.array_join(F.transform(F.split(s["canon"], r"\."), lambda o, j: F.when(F.length(o) == 3, rnd(j + 1) % 156 + 100)
                                      .when(F.length(o) == 2, rnd(j + 1) % 90 + 10).otherwise(rnd(j + 1) % 10).cast("string")), "")
    octets = (F.when((n == 12) & (F.length(F.regexp_replace(s["canon"], r"\.", "")) < 12), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: (rnd(j) % 156 + 100).cast("string")), ""))
              .when(n == 32, F.concat(F.lit("20010db8"), F.substring(noise, 1, 24))).otherwise(octets))
    all_slots = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")
    body = F.when(kind == "ip", octets).when(kind == "card", F.substr(all_slots, F.lit(1), n - 1)).otherwise(all_slots)
    return F.struct(*[s[c].alias(c) for c in ("m", "kind", "canon", "slots")], body.alias("body"), rnd(n).alias("last"))


def checked(s: Column) -> Column:
    """``(m, kind, canon, slots, new)``: the card's last digit keeps its Luhn validity."""
    slots, body = s["slots"], s["body"]
    right = luhn(F.substr(slots, F.lit(1), F.length(slots) - 1)) == F.substr(slots, F.length(slots), F.lit(1)).cast("int")
    digit = F.when(right, luhn(body)).otherwise((luhn(body) + 1 + s["last"] % 9) % 10)
    new = F.when(s["kind"] == "card", F.concat(body, digit.cast("string"))).otherwise(body)
    return F.struct(*[s[c].alias(c) for c in ("m", "kind", "canon", "slots")], new.alias("new"))


def written(s: Column) -> Column:
    """The surrogate in the format of the mention."""
    m = s["m"]
    title = F.when(s["kind"] == "name", F.regexp_extract(m, "^" + TITLE, 0)).when(s["kind"] == "password", F.regexp_extract(m, "^" + LABEL, 0)).otherwise("")
    body = F.substr(m, F.length(title) + 1)
    # a longer surrogate: the letters too many stand before an e-mail address and behind all others
    front = F.when(s["kind"] == "email", F.greatest(F.length(s["new"]) - F.length(F.regexp_replace(m, r"[^\p{L}0-9]", "")), F.lit(0))).otherwise(0)
    start = F.struct(F.substr(s["new"], F.lit(1), front).alias("out"), (front + 1).alias("k"))

    def step(z, i):
        c, new = _char(body, i), _char(s["new"], z["k"])
        slot = c.rlike(r"[\p{L}0-9]")
        cased = F.when(c != F.lower(c), F.upper(new)).otherwise(new)
        return F.struct(F.concat(z["out"], F.when(slot, cased).otherwise(c)).alias("out"), (z["k"] + F.when(slot, 1).otherwise(0)).alias("k"))

    whole = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), start, step, lambda z: F.concat(z["out"], F.substr(s["new"], z["k"])))
    groups = F.when(F.length(s["new"]) == 12, F.regexp_replace(s["new"], "(...)(?=.)", "$1.")).when(F.length(s["new"]) == 32, F.regexp_replace(s["new"], "(....)(?=.)", "$1:")).otherwise(whole)
    return F.when(s["kind"] == "ip", groups).otherwise(F.concat(title, whole))


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``(kind, canon, slots, n_head, n_tail)`` of the corpus."""
    found = docs.select(F.explode(F.array_distinct(matches(F.col(text_col)))).alias("m")).select(typed(F.col("m")).alias("s"))
    return found.select(identified(F.col("s")).alias("s")).select(slotted(F.col("s")).alias("s")).select("s.kind", "s.canon", "s.slots", "s.n_head", "s.n_tail").distinct()


def rekeyed(found: DataFrame, key: str = KEY) -> DataFrame:
    """``(ident, attempt)`` of the entities whose first surrogate was taken; see the module text.

    Each round one group by surrogate keeps the owner (an entity settled earlier, else the first by
    identity) and sends the others on; it ends when none is left, as later attempts have more room (``widened``).
    """
    waiting = saved(found.withColumn("attempt", F.lit(0)), "entities")
    taken = waiting.select("kind", F.col("slots").alias("new"), F.lit("").alias("canon"), F.lit(-1).alias("attempt"))  # no surrogate may be an entity
    later, rounds = None, 0
    while True:
        s = F.struct(F.lit("").alias("m"), "kind", "canon", "slots", "n_head", "n_tail")
        # lambdas keep one step's expressions out of the next
        new = F.transform(F.array(s), lambda s: keyed(s, F.col("attempt"), key))
        tried = waiting.select("*", F.transform(F.transform(new, replaced), checked)[0]["new"].alias("new"))
        tried = saved(tried, "tried")
        rows = taken.select("kind", "new", F.struct("attempt", "canon").alias("o")).unionByName(
            tried.select("kind", "new", F.struct("attempt", "canon").alias("o")))
        owner = rows.groupBy("kind", "new").agg(F.min("o").alias("o"))
        # an entity settled in an earlier round has the smaller attempt and so stays the owner
        judged = tried.join(owner, ["kind", "new"]).withColumn("good", (F.col("o.canon") == F.col("canon")) & (F.col("o.attempt") == F.col("attempt")))
        judged = saved(judged.drop("o"), "judged")
        good = judged.where("good")
        if rounds:
            settled = good.select(F.concat_ws("|", "kind", "canon").alias("ident"), "attempt")
            later = settled if later is None else later.unionByName(settled)
        bad = judged.where("not good")
        if bad.isEmpty():
            break
        taken = saved(taken.unionByName(good.select("kind", "new", "canon", "attempt")), "taken")
        waiting = bad.select("kind", "canon", "slots", "n_head", "n_tail", (F.col("attempt") + 1).alias("attempt"))
        rounds += 1
    return later if later is not None else found.select(F.lit("").alias("ident"), F.lit(0).alias("attempt")).limit(0)


def replace_private(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_entities`` and ``entity_kinds`` (sorted) added."""
    later = saved(rekeyed(entities(docs, text_col), key), "rekeyed")
    text = F.col(f"`{text_col}`")
    found, again, hashed, out = free(docs, "_found", "_again", "_hash", "_new")
    staged = docs.withColumn(found, F.transform(F.transform(matches(text), typed), identified))
    if later.isEmpty():
        attempt = lambda s: F.lit(0)
    else:
        ident = F.concat_ws("|", "s.kind", "s.canon")
        each = (staged.select(F.xxhash64(text).alias(hashed), F.explode(F.array_distinct(found)).alias("s")).select(hashed, ident.alias("ident"))
                .join(later, "ident").groupBy(hashed).agg(F.map_from_entries(F.collect_set(F.struct("ident", "attempt"))).alias(again)))
        staged = staged.withColumn(hashed, F.xxhash64(text)).join(saved(each, "again"), hashed, "left").drop(hashed)
        attempt = lambda s: F.coalesce(F.try_element_at(again, F.concat_ws("|", s["kind"], s["canon"])), F.lit(0))
    new = F.transform(F.col(found), slotted)
    new = F.transform(new, lambda s: keyed(s, attempt(s), key))
    new = F.transform(F.transform(F.transform(new, replaced), checked), written)
    parts = F.zip_with(F.split(text, PATTERN, -1), new, lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
    staged = staged.withColumn(out, F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col(f"{found}.kind"))), ",")
    counted = F.when(F.size(found) > 0, F.size(found)).otherwise(0).cast("long")
    keep = [F.col(out).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_entities", "entity_kinds")]
    return staged.select(*keep, counted.alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("entity_kinds"))

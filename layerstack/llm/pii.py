"""Surrogates for personal data, with DataFrame operations only.

Detected entities: e-mail addresses, IPv4 addresses, telephone numbers, card numbers, social security
numbers, IBANs, access keys, hexadecimal secrets, values given to a password or token, and names after a title that tells the gender. Each
is replaced by a surrogate of the same type and format: letters stay letters of their script and
case, digits digits, separators stay; top-level domains, country codes, key prefixes and a card's first
digit are kept, a valid card number stays valid, and names become names of the same gender and script.

A surrogate is drawn by a hash of a secret key, the type and the entity's canonical form (lower case,
digits only), so an entity has the same surrogate everywhere, however it is written. Draws are
checked over the whole corpus: a surrogate that two entities of a type share, or that is itself an
entity of the corpus, is kept by the first alone or by none, and the others are drawn again
until all differ. After `SAME_FORMAT` draws a surrogate gets 1, 2, 4, ... drawn characters more (as does a
mailbox without letters and digits, or a hundred of one letter), so there is always another one and draws
come to an end. The draws, not the texts, are joined; texts without entities are not shuffled.

Defined results: null and empty texts stay; rows are kept one to one, equal rows alike; texts without
entities are unchanged to the byte; an input column named like an added one is replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerstack.llm.common import index_of, stored, without

#: Titles and the gender of their names.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
FEMALE = (
    "Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Mme", "Señora", "Señorita", "Sra",
    "Srta", "Signora", "Госпожа", "Κυρία",
)

_WORD = r"\p{Lu}[\p{L}'’-]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Types and their patterns; the first that matches at a place wins. Runs are bounded by look-around and
#: possessive, so matching is linear in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}"
    r"(?![\p{L}\p{N}-])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:ghp_|gho_|sk-|xoxb-)[A-Za-z0-9]{20,64}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9]*+[a-fA-F])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,128}+"
    r"(?![A-Za-z0-9])",
    "assigned": r"(?<=(?i:password|passwd|pwd|secret|token|apikey|api[_-]key) ?[=:] ?[\"']?)"
    r"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{8,128}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(MALE + FEMALE)})\.? {_WORD}(?: {_WORD}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Draws of an entity that keep its format to the character; later ones are longer.
SAME_FORMAT = 4


def _between(first: int, last: int, step: int = 1) -> str:
    return "".join(map(chr, range(first, last + 1, step)))


#: Alphabets from which characters of each kind are drawn: the first kind that a character is of.
ALPHABETS = (
    (r"[0-9]", "0123456789"),
    (r"[\p{IsLatin}&&\p{Ll}]", "abcdefghijklmnopqrstuvwxyz"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    # Scripts without case, by ranges of code points: letters that are words' letters in each.
    (r"[\p{IsHan}&&\p{L}]", _between(0x4E00, 0x9F00, 64)),
    (r"[\p{IsHangul}&&\p{L}]", _between(0xAC00, 0xD7A3, 28)),
    (r"[\p{IsHiragana}&&\p{L}]", _between(0x304B, 0x3062)),
    (r"[\p{IsKatakana}&&\p{L}]", _between(0x30AB, 0x30C2)),
    (r"[\p{IsArabic}&&\p{L}]", _between(0x0628, 0x063A)),
    (r"[\p{IsHebrew}&&\p{L}]", _between(0x05D0, 0x05EA)),
    (r"[\p{IsDevanagari}&&\p{L}]", _between(0x0915, 0x0939)),
    (r"[\p{IsThai}&&\p{L}]", _between(0x0E01, 0x0E2E)),
    # Letters and digits of other scripts.
    (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{N}", "0123456789"),
)
#: Syllables and endings of names by script: male, female and family names.
SYLLABLES = {
    "latin": "al an ar bel bren car cor dan del dor el fen gar hal jan kar lan len mar mil nor ol per "
    "quin ran ros sam ser tal tor ul val ver wil yan zel".split(),
    "cyrillic": "ал ан бор вал вер вла гор дан дар зор кар лад лев мар мил ник рад рос сав тим".split(),
    "greek": "αλ αν βασ γερ δημ ελ θεο κων λεω μαρ νικ παν σταυ τιμ φιλ".split(),
}
ENDINGS = {
    "latin": {"m": "o us an or ert in".split(), "f": "a ia ine elle ina ora".split(),
              "s": "er son man ley ton field".split()},
    "cyrillic": {"m": "ан ей ир ислав".split(), "f": "ана ина ира ислава".split(),
                 "s": "енко ский ович ук".split()},
    "greek": {"m": "ος ης ας".split(), "f": "α η ια".split(), "s": "ιδης ακης ου".split()},
}


def _number(h: Column, at, base: int) -> Column:
    """A number below base, drawn by the hash at a place."""
    return F.pmod(F.xxhash64(h, at), F.lit(base)).cast("int")


def _pick(h: Column, at, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _number(h, at, len(values)) + 1)


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _drawn(c: Column, h: Column, i: Column) -> Column:
    """A character of the same kind; those that are no letter or digit stay."""
    out = None
    for kind, alphabet in ALPHABETS:
        draw = F.substring(F.lit(alphabet), _number(h, i, len(alphabet)) + 1, F.lit(1))
        test = c.rlike(kind)
        out = F.when(test, draw) if out is None else out.when(test, draw)
    return out.otherwise(c)


def _charwise(text: Column, h: Column, keep: int = 0) -> Column:
    draw = lambda c, i: F.when(i < keep, c).otherwise(_drawn(c, h, i))
    return F.array_join(F.transform(_letters(text), draw), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    value = F.transform(
        _letters(F.reverse(digits)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10


def _card(digits: Column, h: Column) -> Column:
    new = _charwise(digits, h, 1)
    body = F.substring(new, F.lit(1), F.length(digits) - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(digits) == 0, F.concat(body, check)).otherwise(new)


def _domain(domain: Column, h: Column, more: Column) -> Column:
    top = F.substring_index(domain, ".", -1)
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    return F.concat(more, _charwise(labels, h), top)


def _more(h: Column, attempt: int, alphabet: str) -> Column:
    """Drawn characters that make a surrogate longer: none at first, then twice as many each time."""
    later = attempt - SAME_FORMAT
    if later < 0:
        return F.lit("")
    places = F.sequence(F.lit(1), F.lit(min(1 << later, 64)))
    draw = lambda i: F.substring(
        F.lit(alphabet), _number(h, i + 1_000_000, len(alphabet)) + 1, F.lit(1)
    )
    return F.array_join(F.transform(places, draw), "")


def _hex(digits: Column, h: Column) -> Column:
    draw = lambda c, i: F.when(
        c.rlike("[0-9]"), _number(h, i, 10).cast("string")
    ).otherwise(F.substring(F.lit("abcdef"), _number(h, i, 6) + 1, F.lit(1)))
    return F.array_join(F.transform(_letters(digits), draw), "")


def _name(word: Column, kind: Column, h: Column, attempt: Column) -> Column:
    """A name of the word's script; each further draw has one more syllable."""
    def of(script: str, gender: str) -> Column:
        syllables = F.transform(
            F.sequence(F.lit(1), attempt + (1 if gender != "s" else 2)),
            lambda i: _pick(h, i, SYLLABLES[script]),
        )
        return F.concat(F.array_join(syllables, ""), _pick(h, F.lit(0), ENDINGS[script][gender]))

    out = None
    for script, test in (
        ("cyrillic", word.rlike(r"^\p{IsCyrillic}")), ("greek", word.rlike(r"^\p{IsGreek}")),
        ("latin", word.rlike(r"^\p{IsLatin}")),
    ):
        for gender in "mfs":
            both = test & (kind == f"name_{gender}")
            made = of(script, gender)
            out = F.when(both, made) if out is None else out.when(both, made)
    return out.otherwise(_charwise(word, h))


def surrogate(kind: Column, canonical: Column, key: str, attempt: int) -> Column:
    """The canonical form of the surrogate that is drawn for an entity at this attempt."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, F.lit(str(attempt))), 256)
    octets = F.transform(
        F.split(canonical, r"\."), lambda _, i: (_number(h, i, 254) + 1).cast("string")
    )
    letters, digits, hexes = (
        _more(h, attempt, a) for a in ("abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef")
    )
    phone = F.concat(
        F.substring_index(canonical, ":", 1), F.lit(":"),
        _charwise(F.substring_index(canonical, ":", -1), h), digits,
    )
    return (
        F.when(kind == "local", F.concat(_charwise(canonical, h), letters))
        .when(kind == "domain", _domain(canonical, h, letters))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "phone", phone)
        .when(kind == "card", F.concat(_card(canonical, h), digits))
        .when(kind == "secret", F.concat(_hex(canonical, h), hexes))
        .when((kind == "assigned") & canonical.rlike("^[0-9a-f]+$"), F.concat(_hex(canonical, h), hexes))
        .when(kind == "key", F.concat(_charwise(canonical, h, 4), digits))
        .when(kind == "iban", F.concat(_charwise(canonical, h, 2), digits))
        .when(kind == "ssn", F.concat(_charwise(canonical, h), digits))
        .when(kind.startswith("name_"), F.concat(_name(canonical, kind, h, F.lit(attempt)), letters))
        .otherwise(F.concat(_charwise(canonical, h), letters))
    )


def _filled(raw: Column, new: Column) -> Column:
    """raw with its letters and digits replaced by those of new, in order and by raw's case.

    What new has more follows at the end.
    """
    solid = F.regexp_replace(new, r"[^\p{L}\p{N}]", "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(state, c):
        mine = F.substring(solid, state["at"], F.lit(1))
        same = F.when(c.rlike(r"\p{Lu}"), F.upper(mine)).otherwise(mine)
        is_solid = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(
            F.concat(state["out"], F.when(is_solid, same).otherwise(c)).alias("out"),
            (state["at"] + is_solid.cast("int")).alias("at"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(solid, s["at"], F.length(solid)))
    return F.aggregate(_letters(raw), start, put, rest)


def _written(kind: Column, raw: Column, new: Column) -> Column:
    """The surrogate in the way the entity was written."""
    country = F.regexp_extract(raw, r"^(\+\d{1,3})(?!\d)", 1)
    rest = F.substring(raw, F.length(country) + 1, F.length(raw))
    phone = F.concat(country, _filled(rest, F.substring_index(new, ":", -1)))
    name = F.when(raw.rlike(r"^\p{Lu}{2,}$"), F.upper(new)).otherwise(F.initcap(new))
    # A longer domain is longer in front.
    longer = (kind == "domain") & (F.length(new) > F.length(raw))
    return (
        F.when(kind == "phone", phone)
        .when((kind == "ip") | longer, new)
        .when(kind.startswith("name_"), name)
        .otherwise(_filled(raw, new))
    )


def _parts(raw: Column) -> Column:
    """An entity's parts, each with its own surrogate: kind, piece (as written) and what follows it.

    Parts of kind keep stay: titles.
    """
    kind = None
    for name, pattern in PATTERNS.items():
        test = raw.rlike(f"^(?:{pattern})$")
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
    part = lambda k, piece, after: F.struct(
        k.alias("kind"), piece.alias("piece"), after.alias("after")
    )
    words = F.split(raw, " ")
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    gender = F.when(title.isin(*FEMALE), F.lit("name_f")).otherwise(F.lit("name_m"))
    last = F.size(words) - 1
    named = F.transform(
        words,
        lambda w, i: part(
            F.when(i == 0, F.lit("keep")).when(i == last, F.lit("name_s")).otherwise(gender),
            w, F.when(i == last, F.lit("")).otherwise(F.lit(" ")),
        ),
    )
    mail = F.array(
        part(F.lit("local"), F.substring_index(raw, "@", 1), F.lit("@")),
        part(F.lit("domain"), F.substring_index(raw, "@", -1), F.lit("")),
    )
    return (
        F.when(kind == "email", mail)
        .when(kind == "name", named)
        # A value is told by what stands before it, which is not part of it.
        .otherwise(F.array(part(F.coalesce(kind, F.lit("assigned")), raw, F.lit(""))))
    )


def _canonical(kind: Column, piece: Column, whole: Column) -> Column:
    """The form by which an entity is known: a mailbox by its whole address."""
    country = F.regexp_extract(piece, r"^(\+\d{1,3})(?!\d)", 1)
    rest = F.substring(piece, F.length(country) + 1, F.length(piece))
    return (
        F.when(kind == "phone", F.concat(country, F.lit(":"), F.regexp_replace(rest, r"\D", "")))
        .when(kind.isin("card", "ssn"), F.regexp_replace(piece, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(piece, " ", ""))
        .when(kind == "key", piece)
        .otherwise(F.lower(piece))
    )


def draw(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical, owner and surrogate for distinct entities, all surrogates of a kind different.

    entities has kind, canonical and owner (what tells entities of equal canonical form apart).
    """
    everyone = stored(entities.distinct(), "pii-entities")
    taken = everyone.select("kind", F.col("canonical").alias("surrogate")).distinct()
    settled, open_, attempt = None, everyone, 0
    while True:
        own = F.concat_ws("|", F.lit(key), F.col("owner"))
        tried = open_.withColumn("own_key", own)
        tried = tried.withColumn("surrogate", _with_owner(key, attempt))
        tried = tried.drop("own_key").join(
            taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left"
        )
        first = tried.where("taken IS NULL").groupBy("kind", "surrogate").agg(
            F.min(F.struct("canonical", "owner")).alias("first")
        )
        tried = stored(
            tried.join(first, ["kind", "surrogate"], "left").withColumn(
                "won",
                F.col("taken").isNull()
                & F.col("first").eqNullSafe(F.struct("canonical", "owner")),
            ).select("kind", "canonical", "owner", "surrogate", "won"),
            "pii-draw",
        )
        won = tried.where("won").drop("won")
        settled = won if settled is None else settled.union(won)
        open_ = tried.where("NOT won").select("kind", "canonical", "owner")
        if open_.isEmpty():
            return settled
        taken = taken.union(won.select("kind", "surrogate"))
        attempt += 1


def _with_owner(key: str, attempt: int) -> Column:
    """The draw for an entity; its owner takes part where there is one."""
    kind, canonical = F.col("kind"), F.col("canonical")
    h = F.sha2(F.concat_ws("|", "own_key", F.lit(attempt)), 256)
    more = _more(h, attempt, "abcdefghijklmnopqrstuvwxyz")
    return F.when(
        kind == "local", F.concat(_charwise(canonical, h), more)
    ).otherwise(surrogate(kind, canonical, key, attempt))


def replace(df: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """All rows with entities in the text replaced; adds their number."""
    text = df.columns[index_of(df, text)]
    base = without(df, count)
    body = F.col(f"`{text}`")
    # A cheap look first: most texts have no character that an entity needs.
    titles = F.lit(False)
    for title in MALE + FEMALE:
        titles = titles | F.contains(body, F.lit(title))
    hit = F.coalesce((body.rlike("[0-9@]") | titles) & body.rlike(PATTERN), F.lit(False))
    clean = base.where(~hit).withColumn(count, F.lit(0))
    names = base.columns
    held = base.where(hit).select(
        F.monotonically_increasing_id().alias("_row"),
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)],
    )
    held = stored(held, "pii-texts")
    body = F.col(f"_c{names.index(text)}")
    matches = F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    found = held.select("_row", F.posexplode(matches).alias("at", "raw"))
    found = found.select("_row", "at", "raw", F.posexplode(_parts(F.col("raw"))).alias("sub", "p"))
    kind, piece = F.col("p.kind"), F.col("p.piece")
    found = found.select(
        "_row", "at", "sub", kind.alias("kind"), piece.alias("piece"), F.col("p.after").alias("after"),
        _canonical(kind, piece, F.col("raw")).alias("canonical"),
        F.when(kind == "local", F.lower("raw")).otherwise(F.lit("")).alias("owner"),
    )
    found = stored(found, "pii-found")
    drawn = draw(found.where("kind <> 'keep'").select("kind", "canonical", "owner"), key)
    found = found.join(drawn, ["kind", "canonical", "owner"], "left")
    new = F.when(F.col("kind") == "keep", F.col("piece")).otherwise(
        _written(F.col("kind"), F.col("piece"), F.col("surrogate"))
    )
    found = found.select("_row", "at", "sub", F.concat(new, "after").alias("new"))
    pieces = found.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("at", "sub", "new"))).alias("news"),
        F.countDistinct("at").cast("int").alias("_n"),
    )
    gaps = F.split(body, PATTERN, -1)
    ends = F.transform(
        gaps,
        lambda gap, i: F.concat(
            gap, F.array_join(F.transform(
                F.filter(F.col("news"), lambda n: n["at"] == i), lambda n: n["new"]
            ), ""),
        ),
    )
    out = held.join(pieces, "_row").select(
        *[
            (F.array_join(ends, "") if c == text else F.col(f"_c{i}")).alias(c)
            for i, c in enumerate(names)
        ],
        F.col("_n").alias(count),
    )
    return clean.unionByName(out) if len(set(names)) == len(names) else clean.union(out)

"""Personal data: spans by fixed patterns, and further spans by weak supervision.

Looser patterns propose candidates: also keys, tokens and passwords. Four labelers vote on each (pattern
strength, gazetteers, context words, neighbouring characters; each may abstain). Expectation-maximisation
over the counts of vote patterns estimates how reliable the labelers are, without any label; a logistic
classifier of votes, length, digits and the signs beside a candidate, trained on the posteriors, then
decides which candidates are added to the fixed spans.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, table

_RUN = "[A-Za-z0-9._%+-]"
#: Fixed patterns, in an equivalent form that looks at every character once or twice: runs are taken
#: whole (possessive) and begin at their first character or where the last match ended.
BASE = {
    "email": rf"(?:(?<!{_RUN})|\G){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser ones, for candidates only.
LOOSE = {
    "email": rf"(?:(?<!{_RUN})|\G){_RUN}++(?: ?[\(\[]at[\)\]] ?[A-Za-z0-9-]++(?:(?:\.| ?[\(\[]dot[\)\]] ?| dot )[A-Za-z0-9-]{{2,}}+)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]{{2,}}+)++)",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{16}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{4}(?![0-9])|(?<![0-9+A-Za-z])(?:00|\(|0)[0-9][\x20()./0-9-]{5,18}[0-9](?![0-9])",
    "id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?:[A-Za-z0-9_+/-]{16,}+={0,2}(?:\.[A-Za-z0-9_+/-]{8,}+){0,2}(?![A-Za-z0-9_+/=-])|(?<=[Pp]assword[:=]|[Pp]assword[:=] |passwd[:=]|pwd[:=])[^\s\"'<>]{6,64}+)",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|name is|heiße|m'appelle|me llamo)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,2}",
}
KINDS = ["email", "ip", "card", "phone", "id", "secret", "name"]
#: Gazetteers (fixed values).
TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "co", "ai", "app", "dev", "me", "tv", "cloud", "online", "shop", "site",
    "uk", "de", "fr", "es", "it", "nl", "be", "ch", "at", "pt", "pl", "se", "no", "dk", "fi", "is", "ie", "eu", "cz", "sk", "hu", "ro", "bg", "gr", "hr", "si",
    "lt", "lv", "ee", "ua", "ru", "tr", "il", "sa", "ae", "ir", "in", "pk", "cn", "hk", "tw", "jp", "kr", "sg", "my", "th", "vn", "id", "ph", "au", "nz", "us",
    "ca", "mx", "br", "ar", "cl", "pe", "ve", "za", "ng", "ke", "eg", "ma",
]
COUNTRY_CODES = [
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57",
    "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98", "212", "234", "254", "351", "352", "353", "354", "358", "359",
    "370", "371", "372", "380", "385", "386", "420", "421", "852", "886", "966", "971", "972",
]
IBAN_COUNTRIES = [
    "AD", "AE", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IL", "IS", "IT", "LI", "LT", "LU", "LV", "MC",
    "MT", "NL", "NO", "PL", "PT", "RO", "RS", "SE", "SI", "SK", "SM", "TR", "UA",
]
GIVEN_NAMES = [
    "james", "john", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "charles", "daniel", "matthew", "anthony", "mark", "paul", "steven",
    "andrew", "george", "peter", "edward", "brian", "kevin", "mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen",
    "nancy", "lisa", "margaret", "emma", "emily", "laura", "helen", "anna", "jane", "alice", "hans", "karl", "klaus", "jürgen", "wolfgang", "stefan", "thorsten",
    "ursula", "monika", "petra", "sabine", "heike", "katrin", "greta", "jean", "pierre", "michel", "luc", "jacques", "philippe", "nicolas", "antoine", "marie",
    "claire", "sophie", "julie", "camille", "isabelle", "nathalie", "juan", "josé", "carlos", "pedro", "luis", "miguel", "javier", "antonio", "maría", "carmen",
    "lucía", "ana", "elena", "isabel", "marta", "pilar", "mohammed", "fatima", "ahmed", "ali", "chen", "wei", "yuki", "hiroshi", "ivan", "olga", "natasha", "dmitri",
]
#: Words that stand before personal data, and before other numbers.
CUES = [
    "mail", "contact", "write", "phone", "tel", "call", "mobile", "fax", "ssn", "social", "iban", "account", "card", "visa", "address", "name", "ip", "kontakt", "telefon",
    "anruf", "karte", "konto", "téléphone", "appel", "carte", "correo", "teléfono", "tarjeta",
]
SECRET_CUES = ["token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api", "key", "auth", "bearer", "credential", "signature", "private", "schlüssel", "kennwort", "passwort", "clave", "contraseña", "clé", "jeton"]
COUNTER_CUES = ["version", "isbn", "issn", "page", "section", "chapter", "article", "vol", "figure", "serial", "order", "invoice", "commit", "checksum", "sha", "md5", "http", "https"]
#: How keys of well-known services begin, and lengths of keys written in hexadecimal digits.
SECRET_FORMS = r"^(?:AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abp]-|eyJ|ya29|SG\.)|^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
REACH = 40
STEPS, THRESHOLD = 200, 0.5


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: (start, end, m, before, after), in code points, end exclusive.

    Between two matches lies a piece of the split text; lengths of pieces and matches add up to places.
    """
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")),
    )
    row = lambda s, e, m, b, a: F.struct(s.alias("start"), e.alias("end"), m.alias("m"), b.alias("before"), a.alias("after"))
    nothing = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")

    def step(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(F.coalesce(x["m"], F.lit("")))
        here = row(start, end, x["m"], F.right(x["gap"], F.lit(REACH)), F.lit(""))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(here))).alias("out"))

    spans = F.aggregate(found, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step)["out"]
    return F.transform(spans, lambda x: row(x["start"], x["end"], x["m"], x["before"], F.substr(text, x["end"] + 1, F.lit(1))))


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "secret":
        return _mixed(m)
    return F.lit(True)


def _mixed(m: Column) -> Column:
    """Letters and digits, changing often enough for a random run: no word, no number, no date."""
    changes = F.regexp_count(m, F.lit("[A-Za-z](?=[0-9])")) + F.regexp_count(m, F.lit("[0-9](?=[A-Za-z])"))
    return F.when(F.char_length(m) < 16, m.rlike("[A-Za-z]") & m.rlike("[^A-Za-z]")).otherwise(changes >= 3)


def _word(c: Column, words: list[str]) -> Column:
    return c.rlike(r"(?i)(?<![\p{L}])(?:" + "|".join(words) + r")[\p{L}]{0,6}(?![\p{L}])")


def votes(kind: str, x: Column, strict: Column, fixed: bool) -> list[Column]:
    """Votes of the four labelers: 1 personal, -1 not, 0 abstains."""
    m, digits = x["m"], F.regexp_replace(x["m"], "[^0-9]", "")
    if kind == "email":
        known = F.when(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(TLDS), 1).otherwise(-1)
    elif kind == "phone":
        known = F.when(m.rlike(r"^(?:\+|00)(?:" + "|".join(COUNTRY_CODES) + ")"), 1).when(F.char_length(digits).between(8, 15), 0).otherwise(-1)
    elif kind == "id":
        known = F.when(m.rlike("^(?:" + "|".join(IBAN_COUNTRIES) + ")[0-9]"), 1).when(m.rlike("^[A-Z]"), -1).otherwise(0)
    elif kind == "card":
        known = F.when(digits.rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)"), 1).otherwise(-1)
    elif kind == "secret":
        known = F.when(m.rlike(SECRET_FORMS), 1).otherwise(0)
    elif kind == "name":
        known = F.when(F.exists(F.split(F.lower(m), " "), lambda w: w.isin(GIVEN_NAMES)), 1).otherwise(0)
    else:
        known = F.when(m.rlike(r"^0?\.|^0\.|^(?:[0-9]\.){3}[0-9]$"), -1).otherwise(0)
    context = F.when(_word(x["before"], COUNTER_CUES), -1).when(_word(x["before"], SECRET_CUES if kind == "secret" else CUES), 1).otherwise(0)
    beside = r"[\p{L}0-9_/=#]"
    odd = F.right(x["before"], F.lit(1)).rlike(beside) | x["after"].rlike(beside)
    if kind == "secret":  # a value given to a name, or in quotes
        around = F.when(x["before"].rlike("[:=] ?[\"'`]?$|[\"'`]$"), 1).when(odd, -1).otherwise(0)
    else:
        around = F.when(odd, -1).otherwise(1)
    return [F.when(strict, 1).otherwise(-1) if fixed else F.lit(0), known, context, around]


def matches(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Matches of the fixed and of the loose patterns by kind; texts that cannot have any are not searched."""
    has_digit = text.rlike("[0-9]")
    wanted = {"email": text.contains("@"), "ip": has_digit & text.contains("."), "card": has_digit, "phone": text.contains("+")}
    may = {
        "email": text.contains(" dot ") | text.contains("at]") | text.contains("at)"),
        "card": has_digit,
        "phone": has_digit,
        "id": has_digit,
        "secret": has_digit | text.rlike("[Pp]assw|pwd"),
        "name": F.lit(True),
    }
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    raw = {k: F.when(wanted[k], find(text, p)).otherwise(none) for k, p in BASE.items()}
    loose = {k: F.when(may[k], find(text, p)).otherwise(none) for k, p in LOOSE.items()}
    return raw, loose


#: Upper bounds of the classes of length and of share of digits (fixed values).
LENGTHS, SHARES = (8, 14, 18, 24, 40), (0.25, 0.6, 0.95)


def shape(x) -> Column:
    """Length class, class of share of digits, and the kinds of the characters before and after, as one number."""
    n, digits = F.char_length(x["m"]), F.regexp_count(x["m"], F.lit("[0-9]"))
    length = sum((n > k).cast("int") for k in LENGTHS)
    share = sum((digits > k * n).cast("int") for k in SHARES)
    sort = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 0).when(c.rlike("[\"'`(<\\[:=]"), 1).when(c.rlike(r"[\p{L}0-9_/-]"), 2).otherwise(3)
    return ((length * 4 + share) * 4 + sort(F.right(x["before"], F.lit(1)))) * 4 + sort(x["after"])


def unshape(number: int) -> tuple[int, int, int, int]:
    return number // 64, number // 16 % 4, number // 4 % 4, number % 4


def _voted(kind: str, spans: Column, fixed: bool) -> Column:
    def one(x):
        strict = valid(kind, x["m"]) if fixed else F.lit(False)
        r, g, c, s = votes(kind, x, strict, fixed)
        return F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), strict.alias("base"),
            *(v.cast("int").alias(n) for n, v in zip("rgcs", (r, g, c, s), strict=True)), shape(x).alias("shape"),
        )

    return F.transform(spans, one)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``cands``: every match of every pattern with its votes."""
    text = F.coalesce("text", F.lit(""))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(*rest, text.alias("_t"))
    raw, loose = matches(F.col("_t"))
    found = rows.select(*rest, *(c.alias(f"_b_{k}") for k, c in raw.items()), *(c.alias(f"_l_{k}") for k, c in loose.items()))
    # a run of digits that is no card by length is no candidate
    cards = F.filter("_b_card", lambda x: F.char_length(F.regexp_replace(x["m"], "[^0-9]", "")).between(16, 19))
    fixed = [_voted(k, cards if k == "card" else F.col(f"_b_{k}"), True) for k in BASE]
    # a loose match that fails its kind's check is no candidate either
    passing = lambda kind: F.filter(f"_l_{kind}", lambda x: valid(kind, x["m"]))
    more = [_voted(k, passing(k), False) for k in LOOSE]
    return found.select(*rest, F.concat(*fixed, *more).alias("cands"))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def estimate(patterns: list[tuple]) -> list[tuple[tuple, float, float]]:
    """EM for two classes. ``patterns``: (kind, (votes), count). Returns (kind and votes, posterior, count).

    Labelers are independent given the class. A vote's chance depends on labeler and class, and to abstain
    tells nothing; the prior depends on the kind. It starts from the mean vote. Labelers are taken to be no
    worse than chance.
    """
    post = [_sigmoid(1.5 * sum(v)) for _, v, _ in patterns]
    for _ in range(STEPS):
        right, prior = {}, {}
        for c in (0, 1):
            weight = [n * (p if c else 1 - p) for (_, _, n), p in zip(patterns, post, strict=True)]
            for j in range(4):
                cast = [(v[j], w) for (_, v, _), w in zip(patterns, weight, strict=True) if v[j]]
                well = sum(w for vote, w in cast if vote == (1 if c else -1))
                right[j, c] = (well + 1.5) / (sum(w for _, w in cast) + 2.0)
            for k in {k for k, _, _ in patterns}:
                prior[k, c] = sum(w for (kk, _, _), w in zip(patterns, weight, strict=True) if kk == k) + 1.0
        chance = {}
        for j in range(4):
            yes, no = right[j, 1], right[j, 0]
            if yes + no < 1:  # it would speak for the other side: it says nothing
                yes = no = 0.5
            chance[j, 1], chance[j, -1], chance[j, 0] = math.log(yes / (1 - no)), math.log((1 - yes) / no), 0.0
        new = [_sigmoid(math.log(prior[k, 1] / prior[k, 0]) + sum(chance[j, v[j]] for j in range(4))) for k, v, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(post, new, strict=True))
        post = new
        if moved < 1e-9:
            break
    return [((k, v), p, n) for (k, v, n), p in zip(patterns, post, strict=True)]


#: Columns of the classifier: 1, the kind, four votes, and classes of the shape.
_PLACES = [("length", k) for k in range(len(LENGTHS) + 1)] + [("share", k) for k in range(len(SHARES) + 1)] + [("before", k) for k in range(4)] + [("after", k) for k in range(4)]


def _features(kind: str, v: tuple, form: int) -> list[float]:
    parts = dict(zip(("length", "share", "before", "after"), unshape(form), strict=True))
    return [1.0, *(1.0 if kind == k else 0.0 for k in KINDS), *(float(x) for x in v), *(1.0 if parts[name] == k else 0.0 for name, k in _PLACES)]


def fit(rows: list[tuple[str, tuple, int, float, float]]) -> list[float]:
    """Weights of a logistic classifier on soft labels, by full-batch gradient steps (deterministic).

    ``rows``: (kind, votes, shape, posterior, count); a pattern weighs the logarithm of its count.
    """
    x = np.array([_features(k, v, form) for k, v, form, _, _ in rows])
    p = np.array([p for *_, p, _ in rows])
    share = np.log1p(np.array([n for *_, n in rows], float))
    share /= share.sum() or 1.0
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        w -= x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) - p)) + 0.002 * w
    return [round(float(a), 6) for a in w]


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``base`` and ``spans``: arrays of (kind, start, end), by kind and start.

    ``base`` holds the matches of the fixed patterns that pass their checks (leftmost, non-overlapping
    for each kind, failing ones dropped without retry); ``spans`` also those candidates the classifier
    accepts that touch no base span. Places are code points, ends exclusive. Null and empty texts have
    no spans; an empty table gives an empty result. Other columns pass through, repeated rows are
    scanned each; columns named like the added ones are replaced.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.drop("base", "spans", "cands")
    rows = shelf.put(scan(docs))
    counted = rows.select(F.explode("cands").alias("x")).groupBy("x.kind", "x.r", "x.g", "x.c", "x.s", "x.shape").agg(F.count(F.lit(1)).alias("n"))
    # the classes of kinds, votes and shapes bound the patterns, however large the table
    seen = sorted((r["kind"], (r["r"], r["g"], r["c"], r["s"]), r["shape"], r["n"]) for r in counted.collect())
    patterns: dict[tuple, int] = {}
    for kind, v, _, n in seen:
        patterns[kind, v] = patterns.get((kind, v), 0) + n
    posterior = {key: p for key, p, _ in estimate([(k, v, n) for (k, v), n in sorted(patterns.items())])} if patterns else {}
    weights = fit([(k, v, form, posterior[k, v], n) for k, v, form, n in seen]) if seen else [0.0] * (5 + len(KINDS) + len(_PLACES))
    bias = F.create_map(*[F.lit(x) for k, w in zip(KINDS, weights[1 : 1 + len(KINDS)], strict=True) for x in (k, w)])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    last, forms = weights[1 + len(KINDS) : 5 + len(KINDS)], weights[5 + len(KINDS) :]
    by_form = {f: round(sum(w for w, (name, k) in zip(forms, _PLACES, strict=True) if dict(zip(("length", "share", "before", "after"), unshape(f), strict=True))[name] == k), 6) for _, _, f, _ in seen}
    by_form = F.create_map(*[F.lit(x) for k, w in sorted(by_form.items()) for x in (k, w)]) if by_form else F.create_map(F.lit(0), F.lit(0.0))
    plain = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    ranked = lambda a: F.transform(
        F.array_sort(F.array_distinct(F.transform(a, lambda x: F.struct(F.element_at(order, x["kind"]).alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))), plain
    )
    score = lambda x: F.lit(weights[0]) + F.element_at(bias, x["kind"]) + F.element_at(by_form, x["shape"]) + sum(x[n] * F.lit(w) for n, w in zip("rgcs", last, strict=True))
    limit = math.log(THRESHOLD / (1 - THRESHOLD))
    rows = rows.withColumn("base", ranked(F.filter("cands", lambda x: x["base"])))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    # fixed matches that failed their check have voted, but "drop" holds: only loose ones are added
    more = F.filter("cands", lambda x: ~x["base"] & (x["r"] == 0) & (score(x) >= limit))
    rows = rows.withColumn("_more", F.filter(F.transform(more, plain), apart))
    # of two added spans of different kinds that overlap the one that begins first stays, then the longer one
    longer = F.array_sort(F.transform("_more", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    step = lambda a, x: F.when(F.coalesce(F.element_at(a, -1)["end"] > x["start"], F.lit(False)), a).otherwise(F.concat(a, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end")))))
    single = F.when(F.size("_more") > 1, F.aggregate(longer, nothing, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end")))).otherwise(step(a, x)))).otherwise(F.col("_more"))
    added = F.when(F.size("_more") > 0, ranked(F.concat("base", single))).otherwise(F.col("base"))
    return rows.select(*[c for c in docs.columns if c != "text"], "base", added.alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))

"""Recognition rules as data. Scores are whole hundredths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docveil.functions import checks, textfold
from docveil.functions.names import AMBIGUOUS, GIVEN
from docveil.operators.match import literal, spans_sql

FLOOR, THRESHOLD = 30, 50
CONTEXT, BOOST = 60, 35
FINDINGS = "array<struct<start:int,end:int,entity:string,label_type:string,score:int,text:string,canonical:string,source:string>>"

RAW = FINDINGS.replace("canonical:string,", "")


@dataclass(frozen=True)
class Rule:
    """valid: None to take every match, else a column function; a match for which it fails is dropped, or, with
    `keep_invalid`, keeps its score, while a valid one gets at least `valid_score`. cues: words in the CONTEXT characters to
    the left that add `boost`. inner: the part of the match that is the finding, as a pattern within it. needs: a cheap
    pattern without which a text has no match, so that it is not searched. without: a finding that this pattern meets whole is
    dropped; past: so is one that it meets where the finding ends."""

    name: str
    entity: str
    label_type: str
    pattern: str
    score: int
    valid: Callable[[Column], Column] | None = None
    valid_score: int = 60
    keep_invalid: bool = False
    cues: tuple[str, ...] = ()
    boost: int = BOOST
    inner: str | None = None
    strict_only: bool = False
    last: bool = False  # inner is the last place at which its text stands in the match, else the first
    needs: str | None = None
    without: str | None = None
    past: str | None = None


CAPITAL = "A-ZÇĞİÖŞÜÂÎÛƏ"
SMALL = "a-zçğıöşüâîûə"
NAME = f"[{CAPITAL}][{SMALL}{CAPITAL}'’-]+"
MONTHS = "(?:Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık)"
FORMS = r"(?:A\.Ş\.|AŞ|Ltd\. ?Şti\.|LTD\. ?ŞTİ\.|Limited Şirketi|Anonim Şirketi|GmbH|LLC|Inc\.|Ltd\.|PLC|AG|Corp\.|S\.A\.)"

ROLES = "davacı|davalı|vekili|müvekkil|sanık|müşteki|tanık|şüpheli|mağdur|borçlu|alacaklı|mirasçı|muris|işçi|claimant|defendant|plaintiff|witness"
EDGE = f"(?<![{CAPITAL}{SMALL}0-9_.])"
STOP = f"(?![{CAPITAL}{SMALL}0-9_])"
#: Words with a capital that are no part of a person's name, and abbreviations that are no initials.
NO_NAMES = "Mahkeme(?:si)?|Müdürlü(?:k|ğü)|Bakanlı(?:k|ğı)|Başkanlı(?:k|ğı)|Belediye(?:si)?|Üniversite(?:si)?|Kurum(?:u)?|Kurul(?:u)?|Banka(?:sı)?|Sayın|Madde|Kanun(?:u)?|Sözleşme(?:si)?|Court|Agreement|Ltd|A\\.Ş"
NO_NAME = rf"(?:.* )?(?:{NO_NAMES})(?: .*)?"
#: What several rules need. A gate that rules share is looked for once in a text.
DIGITS, ROLE = "[0-9]{3}", rf"(?<![{CAPITAL}{SMALL}])(?i:{ROLES})"
SURE, GIVEN_ALL = ("|".join(n for n in GIVEN if n not in AMBIGUOUS), "|".join(GIVEN))

#: What is asked of a place comes in order of how often it fails: most are no capital.
GIVEN_GATE = f"(?=[{CAPITAL}])(?<![{CAPITAL}{SMALL}0-9_.])(?:{GIVEN_ALL})"

RULES: list[Rule] = [
    Rule("email", "EPOSTA", "EPOSTA", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}", 100, needs="@"),
    Rule("ip", "IP", "IP", r"(?<![0-9])(?<![0-9][.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9]|[.][0-9])", 60, lambda t: F.forall(F.split(t, "[.]"), lambda p: p.cast("int") <= 255), needs="[0-9][.][0-9]"),
    Rule("card", "KART", "KART", r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,4}", 30, checks.luhn, 100, needs=DIGITS),
    Rule("iban", "IBAN_CODE", "IBAN", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?", 50, checks.iban, 100, needs="[A-Z]{2}[0-9]{2}"),
    Rule("iban_tr", "IBAN_CODE", "IBAN", r"TR[0-9]{2}(?: ?[0-9]{4}){5} ?[0-9]{2}", 70, needs="TR[0-9]{2}"),
    Rule("national_id", "TR_NATIONAL_ID", "TCKN", r"(?<![0-9])[1-9][0-9]{10}(?![0-9])", 60, checks.national_id, 85, needs=DIGITS),
    Rule("national_id_context", "TR_NATIONAL_ID", "TCKN", r"(?:T[.]?C[.]? ?(?:Kimlik)?(?: No)?|TCKN) ?[:.]? ?[0-9]{11}", 75, inner="[0-9]{11}", needs=DIGITS),
    Rule("tax_id", "TR_VKN", "VKN", r"(?<![0-9])[0-9]{10}(?![0-9])", 40, checks.tax_id, 40, cues=("vergi", "vkn", "v.d.", "tax"), boost=45, needs=DIGITS),
    Rule("phone_prefixed", "TR_TELEFON", "TELEFON", r"(?<![0-9])(?:[+]90|0090|0) ?[(]?[2-5][0-9]{2}[)]?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}(?![0-9])", 70, cues=("tel", "gsm", "telefon", "cep"), needs=DIGITS),
    Rule("phone_bare", "TR_TELEFON", "TELEFON", r"(?<![0-9])[2-5][0-9]{2}[ -][0-9]{3}[ -][0-9]{2}[ -]?[0-9]{2}(?![0-9])", 35, cues=("tel", "gsm", "telefon", "cep", "phone"), needs=DIGITS),
    Rule("phone_foreign", "TR_TELEFON", "TELEFON", r"[+](?:[1-8][0-9]?|9[1-9])[0-9]? ?[(]?[0-9]{1,4}[)]?(?:[ -]?[0-9]{2,4}){2,4}", 70, cues=("tel", "phone", "mobile"), needs=DIGITS),
    Rule("mersis", "TR_MERSIS", "MERSIS", r"(?<![0-9])[0-9]{16}(?![0-9])", 20, cues=("mersis",), boost=65, needs=DIGITS),
    Rule("registry", "TR_SICIL_NO", "SICIL_NO", r"(?i:ticaret sicil|trade registry|sgk|sicil)(?: no)?[: ]+[0-9][0-9./-]{2,20}", 80, inner="[0-9][0-9./-]*$", needs=DIGITS),
    Rule("birth_numeric", "TR_DOGUM_TARIHI", "DOGUM_TARIHI", r"(?i:doğum tarihi|d[.]tarihi|date of birth|born on)[: ]+[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}", 85, inner="[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}", needs=DIGITS),
    Rule("birth_iso", "TR_DOGUM_TARIHI", "DOGUM_TARIHI", r"(?i:date of birth|dob)[: ]+[0-9]{4}-[0-9]{2}-[0-9]{2}", 85, inner="[0-9]{4}-[0-9]{2}-[0-9]{2}", needs=DIGITS),
    Rule("birth_month", "TR_DOGUM_TARIHI", "DOGUM_TARIHI", rf"(?i:doğum tarihi)[: ]+[0-9]{{1,2}} {MONTHS} [0-9]{{4}}", 85, inner=rf"[0-9]{{1,2}} {MONTHS} [0-9]{{4}}", needs=DIGITS),
    Rule("plate", "PLAKA", "PLAKA", r"(?:0[1-9]|[1-7][0-9]|8[01]) ?[A-Z]{1,3} ?[0-9]{2,4}", 60, needs="[0-9][A-Z ]"),
    Rule("case_labelled", "TR_DOSYA_NO", "DOSYA_NO", r"(?i:dosya no|esas no|karar no|case no|claim no)[: ]+[0-9]{4}/[0-9]+", 85, inner="[0-9]{4}/[0-9]+", needs=DIGITS),
    Rule("case_kind", "TR_DOSYA_NO", "DOSYA_NO", r"[0-9]{4}/[0-9]+ (?:E|K|Esas|Karar)(?:[.]| )", 75, inner="[0-9]{4}/[0-9]+", needs=DIGITS),
    Rule("passport", "TR_PASAPORT", "PASAPORT", r"(?i:pasaport|passport)(?: no)?[: ]+[A-Z][0-9]{7,8}", 85, inner="[A-Z][0-9]{7,8}", needs=DIGITS),
    Rule("address_street", "TR_ADRES", "ADRES", rf"{NAME}(?: {NAME})* (?:Mah|Cad|Sok|Bulv|Mahallesi|Caddesi|Sokak|Sokağı|Bulvarı)[.]?[^\n]{{0,40}}?No ?[:.]? ?[0-9]+(?:/[0-9]+)?", 75, needs=" (?:Mah|Cad|Sok|Bulv)"),
    Rule("address_label", "TR_ADRES", "ADRES", r"(?i:adres|address) ?: ?[^\n]{8,120}", 85, inner="[^: ][^:]*$", needs="(?i)adres|address"),
    Rule("address_number", "TR_ADRES", "ADRES", rf"(?<![0-9])[0-9]{{1,5}}[A-Za-z]? (?:{NAME} ){{1,4}}(?:Street|Road|Avenue|Lane|Drive|Square|Boulevard|Close)(?![a-z])(?:, ?[{CAPITAL}][{SMALL}]+(?: [{CAPITAL}][{SMALL}]+)*)?(?:,? [A-Z]{{1,2}}[0-9][A-Z0-9]? [0-9][A-Z]{{2}}(?![A-Z0-9])|,? [A-Z]{{2}} [0-9]{{5}}(?![0-9]))?", 75, needs="Street|Road|Avenue|Lane|Drive|Square|Boulevard|Close"),
    Rule("address_european", "TR_ADRES", "ADRES", rf"{EDGE}(?:{NAME}(?:straße|strasse|gasse|platz)|(?:rue|avenue|boulevard|calle|via|plaza) (?:d[eu] |des |de la )?{NAME}(?: {NAME})*),? [0-9]{{1,4}}(?![0-9])", 75, needs="straße|strasse|gasse|platz|rue |avenue |boulevard |calle |via |plaza "),
    Rule("birth_words", "TR_DOGUM_TARIHI", "DOGUM_TARIHI", r"(?i:date of birth|born on|dob)[: ]+[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}", 85, inner="[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}", needs="(?i)birth|born|dob"),
    Rule("birth_year", "TR_DOGUM_TARIHI", "DOGUM_TARIHI", r"(?i:doğum yılı|year of birth|doğumlu|born in)[: ]+(?:19|20)[0-9]{2}(?![0-9./-])", 80, inner="(?:19|20)[0-9]{2}$", needs="(?i)doğum|birth|born"),
    Rule("birth_trailing", "TR_DOGUM_TARIHI", "DOGUM_TARIHI", r"[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2} doğumlu", 85, inner="[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}", needs="doğumlu"),
    Rule("case_line", "TR_DOSYA_NO", "DOSYA_NO", r"(?m)^Sayı ?: ?[0-9A-Z.][0-9A-Za-z./-]{3,40}", 70, inner="[0-9A-Z.][0-9A-Za-z./-]*$", needs="Sayı"),
    Rule("company", "TR_TUZEL_KISI", "SIRKET", rf"(?:{NAME} ){{1,7}}{FORMS}", 75, needs=FORMS),
    Rule("person_role", "PERSON", "KISI", rf"(?i:{ROLES}) ?: ?(?-i:{NAME}(?: {NAME}){{1,3}})", 85, inner=rf"{NAME}(?: {NAME})*$", needs=ROLE, without=NO_NAME, past=f" {FORMS}"),
    Rule("person_title", "PERSON", "KISI", rf"(?:Av[.]|Dr[.]|Prof[.]|Mr[.]|Mrs[.]|Ms[.]|Sayın) ?{NAME}(?: {NAME}){{0,2}}", 80, inner=rf"(?<=[. n] ?){NAME}(?: {NAME})*$", needs="Av[.]|Dr[.]|Prof[.]|Mrs?[.]|Ms[.]|Sayın", without=NO_NAME, past=f" {FORMS}"),
    Rule("person_middle", "PERSON", "KISI", rf"{EDGE}[{CAPITAL}][{SMALL}]+(?: [{CAPITAL}][.]){{1,2}} {NAME}{STOP}", 75, needs=rf" [{CAPITAL}][.] [{CAPITAL}]", without=NO_NAME),
    Rule("person_after_role", "PERSON", "KISI", rf"(?<![{CAPITAL}{SMALL}])(?i:{ROLES}) (?-i:[{CAPITAL}][{SMALL}]+(?: [{CAPITAL}][{SMALL}]+){{1,2}}){STOP}", 65, inner=rf"[{CAPITAL}][{SMALL}]+(?: [{CAPITAL}][{SMALL}]+)+$", needs=ROLE, without=NO_NAME),
    Rule("person_upper_surname", "PERSON", "KISI", rf"[{CAPITAL}][{SMALL}]+ [{CAPITAL}]{{3,}}{STOP}", 60, needs=f"[{CAPITAL}]{{3}}", without=NO_NAME),
    Rule("person_given", "PERSON", "KISI", rf"{EDGE}(?=[{CAPITAL}])(?:{SURE})(?: [{CAPITAL}][{SMALL}]+)?(?: [{CAPITAL}][{SMALL}]+| [{CAPITAL}]{{3,}}){STOP}", 70, needs=GIVEN_GATE, without=NO_NAME, past=f" {FORMS}"),
    Rule("person_ambiguous", "PERSON", "KISI", rf"{EDGE}(?:{'|'.join(sorted(AMBIGUOUS))}) [{CAPITAL}][{SMALL}{CAPITAL}]+{STOP}", 55, needs=GIVEN_GATE, without=NO_NAME, past=f" {FORMS}"),
    Rule("person_polite", "PERSON", "KISI", rf"{EDGE}(?:{GIVEN_ALL}) (?:Hanım|Bey){STOP}", 70, inner=rf"^(?:{GIVEN_ALL})", needs=GIVEN_GATE),
    Rule("person_lone", "PERSON", "KISI", rf"{EDGE}(?=[{CAPITAL}])(?:{SURE}){STOP}", 55, needs=GIVEN_GATE),
    Rule("person_father", "PERSON", "KISI", rf"{EDGE}{NAME} (?:ve|VE) {NAME} (?:oğlu|kızı|OĞLU|KIZI){STOP}", 85, inner=f"^{NAME}", needs="(?i)oğlu|kızı", without=NO_NAME),
    Rule("person_mother", "PERSON", "KISI", rf"{EDGE}{NAME} (?:ve|VE) {NAME} (?:oğlu|kızı|OĞLU|KIZI){STOP}", 85, inner=rf"(?<= (?:ve|VE) ){NAME}(?= (?:oğlu|kızı|OĞLU|KIZI)$)", last=True, needs="(?i)oğlu|kızı", without=NO_NAME),
    Rule("person_initials", "PERSON", "KISI", rf"{EDGE}(?:[{CAPITAL}][.] ?){{2,3}}{STOP}", 60, inner=rf"^(?:[{CAPITAL}][.] ?)*[{CAPITAL}][.]", needs=rf"[{CAPITAL}][.] ?[{CAPITAL}][.]", without="T[.] ?C[.]|A[.] ?Ş[.]|M[.] ?Ö[.]|M[.] ?S[.]|S[.] ?K[.]|Y[.] ?K[.]|U[.] ?S[.]|U[.] ?K[.]"),
    Rule("person_initial_surname", "PERSON", "KISI", rf"{EDGE}[{CAPITAL}][.] ?[{CAPITAL}][{SMALL}]{{2,}}{STOP}", 65, needs=rf"[{CAPITAL}][.] ?[{CAPITAL}][{SMALL}]", without=rf"[{CAPITAL}][.] ?(?:{NO_NAMES})"),
    Rule("person_speaker", "PERSON", "KISI", rf"(?m)(?:[]] ?~?|^~) ?[{CAPITAL}][{SMALL}{CAPITAL}.]*(?: [{CAPITAL}][{SMALL}{CAPITAL}.]*){{0,2}} ?:", 70, inner=rf"[{CAPITAL}][{SMALL}{CAPITAL}.]*(?: [{CAPITAL}][{SMALL}{CAPITAL}.]*)*(?= ?:$)", needs=r"[]~]", without=rf"(?:{NO_NAMES})"),
    Rule("court", "TR_MAHKEME", "MAHKEME", rf"{NAME} [0-9]+[.] [{CAPITAL}][{SMALL}]+ (?:Hukuk|Ceza|İş|Ticaret) Mahkemesi", 70, strict_only=True, needs="Mahkemesi"),
]

DIGIT, CAPITALS = "[0-9]", f"[{CAPITAL}](?:[.]|[{CAPITAL}]{{2}})"
STREETS, TITLES = "Street|Road|Avenue|Lane|Drive|Square|Boulevard|Close", "Av[.]|Dr[.]|Prof[.]|Mrs?[.]|Ms[.]|Sayın"
WORDS = rf"(?=[A-Z])(?:{STREETS}|{TITLES}|{FORMS}|Mah|Cad|Sok|Bulv|Sayı|TR)"
#: What a text must have to match what rules need, so that few texts are searched for it: one of some words (as written, or in
#: lower case), or a pattern that several share. To look for few words is less work than to search by a pattern.
HINTS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys((DIGITS, "[0-9][.][0-9]", "[A-Z]{2}[0-9]{2}", "[0-9][A-Z ]"), (DIGIT,)),
    **dict.fromkeys((STREETS, TITLES, FORMS, " (?:Mah|Cad|Sok|Bulv)", "Sayı", "TR[0-9]{2}"), (WORDS,)),
    **dict.fromkeys((rf" [{CAPITAL}][.] [{CAPITAL}]", rf"[{CAPITAL}][.] ?[{CAPITAL}][.]", rf"[{CAPITAL}][.] ?[{CAPITAL}][{SMALL}]", f"[{CAPITAL}]{{3}}"), (CAPITALS,)),
    "straße|strasse|gasse|platz|rue |avenue |boulevard |calle |via |plaza ": ("straße", "strasse", "gasse", "platz", "rue ", "avenue ", "boulevard ", "calle ", "via ", "plaza "),
    "@": ("@",),
    r"[]~]": ("]", "~"),
    "doğumlu": ("doğumlu",),
    "Mahkemesi": ("Mahkemesi",),
    "(?i)adres|address": ("adres", "address"),
    "(?i)birth|born|dob": ("birth", "born", "dob"),
    "(?i)doğum|birth|born": ("doğum", "birth", "born"),
    "(?i)oğlu|kızı": ("oğlu", "kızı"),
    ROLE: tuple(ROLES.split("|")),
}
#: Of them, those that are looked for in lower case, and those that are patterns.
ANY_CASE = {p for p in HINTS if p.startswith("(?i)")} | {ROLE}
SHARED = (DIGIT, WORDS, CAPITALS)

PROFILES = {"standart": False, "siki": True}


def of_profile(profile: str, rules: list[Rule] = RULES) -> list[Rule]:
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}")
    return [r for r in rules if PROFILES[profile] or not r.strict_only]


def found(text: str, rule: Rule, gate: str | None = None) -> Column:
    """array of findings of one rule in the column text, but for their canonical values, with valid matches only and scores
    from FLOOR up. gate: the column that tells whether what the rule needs is in text, if that is known.

    SQL text, as rules are many and columns take the driver long to build: only the checks of numbers are columns.
    """
    whole, part, first = f"`{text}`", "s.text", "s.start"
    if rule.inner is not None:
        part = f"regexp_extract(s.text, {literal(f'({rule.inner})')}, 1)"
        if rule.last:
            first = "s.start + length(s.text) - instr(reverse(s.text), reverse(f.part)) - length(f.part) + 1"
        elif rule.inner.endswith("$") and not rule.inner.endswith(":$)"):
            first = "s.start + length(s.text) - length(f.part)"
        else:
            first = "s.start + instr(s.text, f.part) - 1"
    score = f"{rule.score}"
    if rule.cues:
        left = f"lower(translate(substring({whole}, greatest(p.first - {CONTEXT}, 0) + 1, p.first - greatest(p.first - {CONTEXT}, 0)), 'Iİ', 'ıi'))"
        score = f"CASE WHEN {' OR '.join(f'contains({left}, {literal(c)})' for c in rule.cues)} THEN {rule.score + rule.boost} ELSE {score} END"
    if rule.without is not None:
        score = f"CASE WHEN p.part RLIKE {literal(f'^(?:{rule.without})$')} THEN 0 ELSE {score} END"
    if rule.past is not None:
        score = f"CASE WHEN substring({whole}, p.first + length(p.part) + 1, 40) RLIKE {literal(f'^(?:{rule.past})')} THEN 0 ELSE {score} END"
    parts = f"transform({spans_sql(whole, rule.pattern)}, s -> struct(s AS s, {part} AS part))"
    placed = f"transform({parts}, f -> struct(f.part AS part, {first.replace('s.', 'f.s.')} AS first))"
    row = f"struct(CAST(p.first AS INT) AS start, CAST(p.first + length(p.part) AS INT) AS end, {literal(rule.entity)} AS entity, {literal(rule.label_type)} AS label_type, least({score}, 100) AS score, p.part AS text, {literal(rule.name)} AS source)"
    # what `without` or `past` drops has the score 0, and no check brings it back
    every = F.expr(f"filter(transform({placed}, p -> {row}), f -> f.score >= {1 if rule.valid else FLOOR} AND f.end > f.start)")
    if rule.valid is not None:
        checked = lambda f: F.when(rule.valid(f["text"]), F.greatest(f["score"], F.lit(rule.valid_score))).otherwise(f["score"] if rule.keep_invalid else 0)
        every = F.filter(F.transform(every, lambda f: f.withField("score", checked(f))), lambda f: f["score"] >= FLOOR)
    return F.when(F.col(text).rlike(rule.needs) if gate is None else F.col(gate), every).otherwise(F.array().cast(RAW)) if rule.needs else every


def detect(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with `candidates`: the findings of all rules in one scan, in order of (start, end, entity, source)."""
    gates = {needs: f"__gate{i}" for i, needs in enumerate(dict.fromkeys(r.needs for r in rules if r.needs))}
    asked = {h for needs in gates for h in HINTS.get(needs, ())}
    shared = {h: f"__hint{i}" for i, h in enumerate(SHARED) if h in asked}
    low = {"__low": F.lower(text)} if ANY_CASE & set(gates) else {}
    out = docs.withColumns(low | {name: F.col(text).rlike(h) for h, name in shared.items()})

    def gate(needs: str) -> Column:
        where = "__low" if needs in ANY_CASE else f"`{text}`"
        hints = [shared.get(h) or f"contains({where}, {literal(h)})" for h in HINTS.get(needs, ())]
        return F.expr(f"CASE WHEN {' OR '.join(hints) or 'true'} THEN `{text}` RLIKE {literal(needs)} ELSE false END")

    out = out.withColumns({name: gate(needs) for needs, name in gates.items()}).drop(*low, *shared.values())
    every = F.concat(*(found(text, r, gates.get(r.needs)) for r in rules)) if rules else F.array().cast(RAW)
    named = lambda f: F.struct(*(f[n] for n in ("start", "end", "entity", "label_type", "score", "text")), textfold.canonical(f["label_type"], f["text"]).alias("canonical"), f["source"])
    return out.withColumn("candidates", F.sort_array(F.coalesce(F.transform(every, named).cast(FINDINGS), F.array().cast(FINDINGS)))).drop(*gates.values())


def exploded(docs: DataFrame, column: str = "candidates", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a finding."""
    return docs.select(*keep, F.inline(column))

"""Personal information in free text: find it and replace it by typed placeholders.

``find`` returns non-overlapping spans of mail addresses, phone numbers, numbers given by an
authority, bank accounts and payment cards, postal addresses, dates of birth and persons. Formats are matched first
and then validated (number of digits, check digits, what stands before); names are recognised by structure: two or
more capital parts beside a title, a role or relation, a verb of contact, a greeting, a label or a signature, and names in
any case beside phrases that only speak of persons.

``pseudonyms`` gives each span a placeholder such as ``[PHONE +44 7193 482019]``. Validated numbers and
dates are permuted by a keyed Feistel network among the valid values of their format (areas that are issued, letters that
are used, check digits that fit) and keep their layout; what is permuted is the canonical form, so a number
written in several ways gets one pseudonym. Other kinds carry a keyed name of 96 bits. Equal values thus stay linked
across documents while the text around them is unchanged.

Null texts hold nothing and stay null; empty texts stay empty. Whole texts are searched,
whatever their length; every pattern is linear in it. Rows are never grouped, so repeated rows and
hot keys cost what they hold. Other columns are not touched.
"""

from __future__ import annotations

import bisect
import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import feistel

KINDS = ("email", "phone", "id_number", "address", "person")

# --- mail -------------------------------------------------------------------------------
_OPEN, _SHUT = r"[\[({<]\s?", r"\s?[\])}>]"
_AT = rf"(?:\s?[@＠]\s?|%40|\s?{_OPEN}(?:at|@|ät|arroba){_SHUT}\s?)"
_DOT = rf"(?:\.|\s?{_OPEN}(?:dot|punkt|point|punto|\.){_SHUT}\s?|\s(?:dot|punkt|point|punto)\s)"
_LOCAL = r"[\w.%+'-]*[\w+]"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
EMAIL = re.compile(rf"(?<![\w.%+'-])(?:mailto:)?{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
EMAIL_WORDS = re.compile(rf"(?<![\w.%+'-]){_LOCAL}\s+(?:at|arroba)\s+{_LABEL}(?:{_DOT}{_LABEL})*(?:\s?{_OPEN}(?:dot|punkt|point|punto){_SHUT}\s?|\s(?:dot|punkt|point|punto)\s){_LABEL}(?:{_DOT}{_LABEL})*", re.I)

# --- numbers given by an authority ------------------------------------------------------
_H = r"[-‐‑–]"
_NO = r"(?:\s?(?:number|nummer|numéro|número|núm|num|nr|no|n[°º])?\.?\s?[:#]?\s?)"
_ID_WORD = (
    r"ssn|social security|sozialversicherungs(?:nummer)?|steuer-?id|sécurité sociale|seguridad social|nir|nino|national insurance|"
    r"passport|passeport|pasaporte|reisepass(?:nummer)?|pass(?:nummer)|ausweis(?:nummer)?|personalausweis(?:nummer)?|identity card|id card|"
    r"carte d'identité|dni|nie|nif|driver'?s? licen[cs]e|driving licen[cs]e|licen[cs]e|führerschein(?:nummer)?|permis de conduire|permiso de conducir"
)
IDS = [
    re.compile(rf"(?<![\w-])\d{{3}}{_H}\d{{2}}{_H}\d{{4}}(?![\w]|-\w)"),
    re.compile(r"(?<![\w-])[12] \d\d \d\d (?:\d\d|2[AB]) \d{3} \d{3} \d\d(?![\w])", re.I),
    re.compile(r"(?<![\w-])[A-Z]{2} \d\d \d\d \d\d [A-D](?![\w])", re.I),
    re.compile(r"(?<![\w-])DL-\d{4}-\d{5}(?![\w])", re.I),
    re.compile(rf"(?<![\w])(?:{_ID_WORD})\b{_NO}(?P<v>(?=[A-Z0-9 -]{{0,6}}\d)[A-Z0-9](?:[A-Z0-9]|[ -](?=[A-Z]{{0,2}}\d)|[ ](?=[A-D]\b)){{5,}})(?![\w])", re.I),
]

# --- phones -----------------------------------------------------------------------------
_EXT = r"(?:\s?(?:ext|x|extension|poste|durchwahl)\.?\s?\d{1,5})?"
_S = r"[ .  ‐‑–/-]"
PHONE = re.compile(
    r"(?<![\w./#:+‐‑–-])(?:"
    rf"(?:\+|00)\d{{1,3}}(?:{_S}?\(?\d{{1,5}}\)?){{2,7}}"  # international
    rf"|(?:1{_S})?\(?[2-9]\d\d\)?{_S}[2-9]\d\d{_S}\d{{4}}"  # ten digits in three groups
    r"|\([2-9]\d\d\) ?[2-9]\d\d[-.‑ ]\d{4}"
    rf"|0\d(?:{_S}\d\d){{4}}"  # pairs
    rf"|0\d{{2,4}}{_S}\d{{3,8}}(?:{_S}\d{{2,6}}){{0,2}}"  # trunk prefix
    r"|[2-9]\d\d[2-9]\d{6}"  # ten digits without a break
    rf")(?![\w]|[.:‐‑–-]\d){_EXT}",
    re.I,
)
#: What a number is called that is no phone; no match is longer than 24 signs, the stretch that is looked at.
_NOT_PHONE = re.compile(r"(?:row\s?id|epoch|checksum|order|ticket|build|version|commit|hash|port|line|cursor|seq|offset|node|batch(?:es)?|job|run|id|=|#|0x)\W{0,3}(?:is\W|at\W|no\W{1,2})?$", re.I)

# --- accounts and cards -----------------------------------------------------------------
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w.+-])[1-9]\d{3}(?:(?:[ -]\d{4}){3}|[ -]\d{6}[ -]\d{5}|\d{9,15})(?![\w]|[.-]\d)")


def _iban_rest(flat: str) -> int:
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def _luhn(digits: str) -> int:
    """0 for a number whose last digit fits."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


# --- postal addresses -------------------------------------------------------------------
_UP = r"(?-i:[A-ZÀ-ÖØ-Þ])[\w'’-]*"
_TOWN = rf"{_UP}(?: (?!(?:The|This|That|An?|Our|My|One|Each|Der|Die|Das|Le|La|Les|El|Los)\b){_UP})?"
_TOWN_ANY = r"[^\W\d_][\w'’-]*"
_WAY = r"(?:street|st\.|st|lane|ln\.?|road|rd\.|rd|avenue|ave\.|ave|court|ct\.?|drive|way|close|place|square|terrace|boulevard|blvd\.?|row|hill)"
_UNIT = r"(?:,?\s(?:apt|apartment|unit|suite|floor|flat|wohnung|apto|piso)\.?\s?\w+)?"
_BREAK = r"(?:\s?,\s?|\s?\r?\n\s?|\\n|\s)"
_PLACE = rf"{_BREAK}(?:\d{{4,5}}\s)?(?:{_TOWN}|{_TOWN_ANY})(?:,?\s\d{{4,5}}(?!\w))?"
_NAMED = rf"(?:{_UP}\s|[a-zà-ÿ'’-]+\s){{1,3}}"
ADDRESSES = [
    re.compile(rf"(?<!\w)(?:p\.?\s?o\.?\sbox|postfach|boîte postale|bp|apartado(?: de correos)?|apdo\.?)\s\d{{1,6}}{_PLACE}", re.I),
    re.compile(rf"(?<![\w.-])(?:(?:flat|apt\.?|apartment|unit)\s\w+,\s)?\d{{1,5}}[a-z]?\s(?!(?:of|on|is|are|the|in|at|to|and|for)\s){_NAMED}{_WAY}(?!\w){_UNIT}{_PLACE}", re.I),
    re.compile(rf"(?<!\w)(?:[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse)|{_UP}(?:\s|-)(?:straße|strasse|weg|platz|allee))\s\d{{1,5}}[a-z]?,?\s?(?:\d{{4,5}}\s)?{_TOWN_ANY}", re.I),
    re.compile(rf"(?<![\w.-])\d{{1,5}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route)\s(?:(?:de la|des|du|de|de l')\s?)?(?:[^\W\d_][\w'’-]*\s?){{1,3}},\s?(?:\d{{4,5}}\s)?{_TOWN_ANY}", re.I),
    re.compile(rf"(?<!\w)(?:calle|avenida|avda\.?|plaza|paseo|camino|c/)\s(?:(?:de la|de los|del|de)\s)?(?:[^\W\d_][\w'’-]*\s){{1,3}}\d{{1,5}},\s?(?:\d{{1,2}}\s?\.?\s?[ºªo°]\s?\w{{0,3}},\s?)?(?:\d{{4,5}}\s)?{_TOWN_ANY}", re.I),
]
#: One of these stands in every address, in lower case.
_STREETS = (
    "street", "lane", "court", "drive", " rd", "road", "po box", "p.o.", " st ", " st.", " st,", "avenue", " ave", " ln", " ct", " way", "close", "place", "square", "terrace", "blvd", "boulevard", " row", " hill",
    "straße", "strasse", "str.", "weg ", "platz ", "allee", "gasse ", "rue ", "chemin", "allée", "impasse", "quai", "route", "calle", "avenida", "avda", "plaza", "paseo", "camino", "c/", "postfach", "postale", "bp ", "apartado", "apdo",
)
#: A number of at least six digits, with or without signs between them, as every phone and most id numbers have.
_LONG = re.compile(r"\d(?:\W{0,2}\d){5}")
_ID_HINTS = tuple("ssn secur sozial steuer nir nino insurance pass ausweis identity card carte dni nie nif licen führer permis pasaporte segur sécur".split())
#: What the words above leave out of the patterns: other blanks, brackets and spellings.
_AT_HINT = re.compile(r"(?:at|ät|arroba)\s?[)\]}>]")
_AT_WORD = re.compile(r"\s(?:at|arroba)\s")
_STREET_HINT = re.compile(r"\s(?:st|rd|ave|ln|ct|way|row|hill)(?!\w)|(?:weg|platz|gasse|rue|bp)\s|p\.?\s?o\.?\sbox")

# --- dates of birth ---------------------------------------------------------------------
BIRTH = re.compile(r"\b(?:born(?: on)?|date of birth|dob|birthday|geboren(?: am)?|geburtsdatum|née? le|fecha de nacimiento|nacid[oa] el)\W{1,3}(?P<v>\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4})", re.I)

# --- persons ----------------------------------------------------------------------------
#: A letter, with the accents written after it.
_L = r"[^\W\d_][\u0300-\u036f]*"
_W = rf"(?:{_L})+(?:['’‐‑-](?:{_L})+)*"
_TITLE = r"(?:mr|mrs|ms|miss|dr|prof|sir|madam|mme|mlle|m|monsieur|madame|herr|herrn|frau|sr|sra|srta|señor|señora|don|doña)"
_INIT = r"[^\W\d_]\."
#: A blank within a line.
_B = r"[ \u00a0\u202f\t]"
#: A name of two parts: title or initial with family name, family name first, or both names.
NAME = rf"(?:{_TITLE}\.?{_B}(?:{_INIT}{_B})?{_W}(?:{_B}(?-i:(?=[A-ZÀ-ÖØ-Þ])){_W})?|(?:{_INIT}{_B}?){{1,2}}{_W}|{_W},{_B}(?:{_INIT}|{_W})|{_W}{_B}(?:{_INIT}{_B})?{_W})"
#: The same, where a phrase follows: without the open end.
NAME_BEFORE = rf"(?:{_TITLE}\.?{_B}(?:{_W}{_B}|{_INIT}{_B})?{_W}|(?:{_INIT}{_B}?){{1,2}}{_W}|{_W},{_B}(?:{_INIT}|{_W})|{_W}{_B}(?:{_INIT}{_B})?{_W})"
#: Phrases before a name (what must stand after it, if anything).
_LEADS = {
    "ask": (r"\b(?:please )?ask\s", r"(?=\s(?:about|for|to|if|whether)\b|[.,;!?\"\\]|\s*$)"),
    "thank": (r"\bthank\s(?:you,?\s)?", ""),
    "promised": (r"\b(?:was )?promised to\s", ""),
    "came from": (r"\bcame from\s", r"(?=[.,;!?\"\\]|\s|$)"),
    "met with": (r"\b(?:met|meeting|spoke|talked|call) with\s", ""),
    "igned": (r"(?:^|(?<=[\s\"]))signed,?\s(?:by\s)?", ""),
    "-- ": (r"(?:^|(?<=[\s\"]))--\s", r"(?=\s|[.,;!?\"\\]|$)"),
    "Bitte ": (r"\bBitte\s", r"(?=\sfragen\b|\sanrufen\b|\sinformieren\b)"),
    "Merci": (r"\bMerci à\s", ""),
    "Demande": (r"\b(?:Demandez|Demande) à\s", ""),
    "Pregunt": (r"\b(?:Pregunta|Pregunte|Preguntar) a\s", ""),
    "Gracias": (r"\bGracias a\s", ""),
    "Danke": (r"\bDanke an\s", ""),
    "Dank an": (r"\bDank an\s", ""),
    "Bei ": (r"\bBei\s", r"(?=\sist\b)"),
    "Laut ": (r"\bLaut\s", r"(?=\sist\b)"),
    "Selon ": (r"\bSelon\s", r"(?=,?\s(?:tout|c'est|il)\b)"),
    "Según ": (r"\bSegún\s", r"(?=,?\s(?:todo|está)\b)"),
    "irmado": (r"\bFirmado,?\s(?:por\s)?", ""),
    "igné,": (r"\bSigné,?\s", ""),
    "ezeichnet": (r"\bgezeichnet,?\s", ""),
    "à vous": (r"\b(?:Bien à vous|Cordialement),?\s", ""),
    "Cordialement": (r"\bCordialement,?\s", ""),
    "Grüße": (r"\bGrüßen?,?\s", ""),
    "Gruß": (r"\bGruß,?\s", ""),
    "aludos": (r"\bSaludos,?\s", ""),
    "tentamente": (r"\bAtentamente,?\s", ""),
    "egards": (r"\bregards,?\s", ""),
    "incerely": (r"\bsincerely,?\s", ""),
    "ame is": (r"\bname is\s", ""),
    "heiße": (r"\bheiße\s", ""),
    "appelle": (r"\bm'appelle\s", ""),
    "llamo": (r"\bme llamo\s", ""),
}
#: Phrases after a name.
_TAILS = {
    "can be reached": r"\s(?:can|may) be reached\b",
    "answers on": r"\sanswers on\b",
    "lives at": r"\slives (?:at|in)\b",
    "wants the": r"\swants the\b",
    "laptop": r"['’]s (?:laptop|phone|desk|office|calendar)\b",
    " will den": r"\swill den\b",
    "ist unter": r"\sist unter\b",
    "wohnt": r"\swohnt\b",
    "liest Post": r"\sliest Post\b",
    "répond": r"\srépond\b",
    "habite": r"\shabite\b",
    "contesta": r"\scontesta\b",
    "vive en": r"\svive en\b",
    "veut le": r"\sveut le\b",
    "quiere el": r"\squiere el\b",
    "lit ses": r"\slit (?:ses|son)\b",
    "lee su": r"\slee su\b",
    "lee el": r"\slee el\b",
}
LEADS = [(k.lower(), re.compile(f"{lead}(?P<v>{NAME}){after}", re.I | re.M)) for k, (lead, after) in _LEADS.items()]
TAILS = [(k.lower(), re.compile(rf"(?<![\w'’.-])(?P<v>{NAME_BEFORE}){tail}", re.I)) for k, tail in _TAILS.items()]
#: A capital part, as names are written within a sentence, and a row of them; at most four make a name.
_CAP = r"[A-ZÀ-ÖØ-Þ](?:(?:[^\W\d_]|[\u0300-\u036f])+|(?=['’]))(?:['’-][A-ZÀ-ÖØ-Þ](?:[^\W\d_]|[\u0300-\u036f])+)*"
PART = re.compile(rf"(?<![\w'’.-])(?:{_CAP}|[A-Z]\.)")
CHAIN = re.compile(rf"(?<![\w'’.-])(?:{_CAP}|[A-Z]\.)(?:{_B}(?:{_CAP}|[A-Z]\.))+")
MOST_PARTS = 4
_ROLES = (
    "colleague|manager|boss|supervisor|client|customer|friend|neighbou?r|wife|husband|partner|brother|sister|mother|father|son|daughter|uncle|aunt|cousin|doctor|nurse|lawyer|attorney|teacher|professor|"
    "engineer|developer|author|director|owner|tenant|patient|employee|intern|contractor|landlord|secretary|accountant|witness|candidate|applicant|assistant|"
    "Kolleg(?:e|in|en)|Chefin|Chef|Kund(?:e|in|en)|Freundin|Freund|Nachbar(?:in|n)?|Bruder|Schwester|Mutter|Vater|Arzt|Ärztin|Anwalt|Anwältin|Lehrer(?:in)?|Mitarbeiter(?:in)?|"
    "collègue|patron(?:ne)?|cliente?|amie?|voisine?|mari|femme|frère|sœur|mère|père|médecin|avocate?|professeure?|"
    "colega|jef[ea]|amig[oa]|vecin[oa]|marido|esposa|herman[oa]|madre|padre|médic[oa]|abogad[oa]|profesora?|compañer[oa]"
)
_CONTACT = r"(?:spoke|talked|speak|talk|chatted)\s(?:to|with)|met|meet|phoned|emailed|mailed|texted|contacted|visited|hired|interviewed|invited|thanked|told"
_MADE = r"(?:written|signed|approved|reviewed|sent|prepared|reported|created|edited|submitted|filed|requested|authored|drafted|recorded|translated)\sby|(?:geschrieben|unterschrieben|gesendet)\svon|(?:écrit|signé|envoyé)\spar|(?:escrito|firmado|enviado)\spor"
_GREET = r"(?:Hi|Hello|Hey|Dear|Hallo|Liebe|Lieber|Bonjour|Salut|Cher|Chère|Hola|Estimad[oa]|Querid[oa]),?"
_LABELS = r"(?:contact|full name|name|author|patient|client|customer|attn|attention|from|to|cc|owner|assignee|employee|kontakt|ansprechpartner(?:in)?|kunde|autor|contacto|nombre|cliente|nom|auteur)\s?[:=]"
_SAYS = r"(?:said|says|replied|emailed|phoned|texted|told\s(?:me|us|him|her|them)|wrote\s(?:to|me|us)|called\s(?:me|us|to|about|back|yesterday|today|this|last)|called\b(?=[.,;!?]|\s*$))"
#: General structure: what comes before or after a row of capital parts. No match is longer than 48 signs.
BEFORE = re.compile(rf"(?:\b(?i:{_ROLES}),?\s|\b(?i:{_CONTACT}|{_MADE})\s|(?<![\w'’-])(?:{_GREET})\s|(?<![\w'’-])(?i:{_LABELS})\s?)$")
AFTER = re.compile(rf"\s{_SAYS}")
TITLED = re.compile(rf"(?<![\w'’.-])(?P<v>(?:Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Herr|Herrn|Frau|Sr|Sra|Srta)\.?\s(?:[^\W\d_]\.\s)?{_W}(?: (?=[A-ZÀ-ÖØ-Þ]){_W})?)")
TITLES = ("Mr", "Ms", "Mrs", "Dr", "Prof", "Mme", "Mlle", "Herr", "Frau", "Sr")
#: Words that are never part of a name (articles, pronouns, conjunctions of the four languages).
_NEVER = frozenset(
    "the a an my our your his her its their this that these those each one some any every it he she we you they i and but or so then when while after before because although if in on at of to for from by with "
    "der die das den dem des ein eine einer mein meine unser unsere jede jeder kein und aber denn weil während obwohl ist war im am um zu bei mit von "
    "le la les un une mon ma mes notre chaque et mais donc car parce que pendant alors il elle nous vous est dans en de du au aux pour par avec "
    "el los las una mi mis nuestro nuestra cada y pero porque mientras aunque es está de del al por con para "
    "nobody everyone somebody someone anyone team support note project office tool".split()
)


_DIGIT = re.compile(r"\d")


_TITLED = re.compile(rf"{_TITLE}\.?$", re.I)


def _name(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The name within a match: words that are never part of one are taken off both ends; what is left
    must be two parts without any."""
    words = [(m.start() + a, m.end() + a) for m in re.finditer(r"[^\s,]+", text[a:b])]
    common = [text[x:y].lower() in _NEVER for x, y in words]
    while words and common[-1]:
        words.pop(), common.pop()
    while words and common[0]:
        words.pop(0), common.pop(0)
    if len(words) < 2 or any(common) or _TITLED.match(text[words[-1][0] : words[-1][1]]):
        return None
    return words[0][0], words[-1][1]


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a text, in order, without overlaps."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    low = text.lower()

    def take(a: int, b: int, kind: str) -> None:
        # spans are kept in order and apart, so only the neighbours of a new one can touch it
        i = bisect.bisect(spans, (a,))
        if (i == 0 or spans[i - 1][1] <= a) and (i == len(spans) or b <= spans[i][0]):
            spans.insert(i, (a, b, kind))

    if "@" in text or "＠" in text or "%40" in text or "at)" in low or "at]" in low or "at}" in low or "at>" in low or "arroba" in low or "(ät" in low or "[ät" in low or _AT_HINT.search(low):
        for m in EMAIL.finditer(text):
            take(*m.span(), "email")
    if ("dot" in low or "punkt" in low or "punto" in low or "point" in low) and _AT_WORD.search(low):
        for m in EMAIL_WORDS.finditer(text):
            take(*m.span(), "email")
    if _DIGIT.search(text):
        long = _LONG.search(text) is not None
        hinted = any(map(low.__contains__, _ID_HINTS))
        for p in IDS if hinted else IDS[:-1] if long else ():
            for m in p.finditer(text):
                take(*(m.span("v") if "v" in p.groupindex else m.span()), "id_number")
        if any(map(low.__contains__, _STREETS)) or _STREET_HINT.search(low):
            for p in ADDRESSES:
                for m in p.finditer(text):
                    take(*m.span(), "address")
        if long:
            for m in IBAN.finditer(text):
                if _iban_rest(re.sub(" ", "", m.group())) == 1:
                    take(*m.span(), "iban")
            for m in CARD.finditer(text):
                flat = re.sub(r"\D", "", m.group())
                if _luhn(flat) == 0 and not _NOT_PHONE.search(text, max(0, m.start() - 24), m.start()):
                    take(*m.span(), "card")
            for m in PHONE.finditer(text):
                digits = sum(map(str.isdigit, m.group()))
                if 8 <= digits <= 20 and not _NOT_PHONE.search(text, max(0, m.start() - 24), m.start()):
                    take(*m.span(), "phone")
        if "bor" in low or "birth" in low or "dob" in low or "gebor" in low or "geburt" in low or "né" in low or "naci" in low:
            for m in BIRTH.finditer(text):
                if _date(m["v"]):
                    take(*m.span("v"), "birth_date")
    for cue, p in LEADS:
        if cue in low:
            for m in p.finditer(text):
                if at := _name(text, *m.span("v")):
                    take(*at, "person")
    for cue, p in TAILS:
        if cue in low:
            for m in p.finditer(text):
                if at := _name(text, *m.span("v")):
                    take(*at, "person")
    for m in CHAIN.finditer(text):
        parts = [p.span() for p in PART.finditer(text, *m.span())]
        for i, (start, _) in enumerate(parts[:-1]):
            if BEFORE.search(text, max(0, start - 48), start):
                at = _name(text, start, parts[min(i + MOST_PARTS, len(parts)) - 1][1])
                if at and at[0] == start:
                    take(*at, "person")
                    break
        else:
            if AFTER.match(text, m.end()) and (at := _name(text, parts[max(0, len(parts) - MOST_PARTS)][0], m.end())):
                take(*at, "person")
    if any(t in text for t in TITLES):
        for m in TITLED.finditer(text):
            if at := _name(text, *m.span("v")):
                take(*at, "person")
    return spans


def _date(v: str) -> dt.date | None:
    try:
        if v[4:5] == "-":
            return dt.date.fromisoformat(v)
        d, m, y = map(int, re.split(r"[./]", v))
        return dt.date(y, m, d)
    except ValueError:
        return None


#: Calling codes of one and two digits; all others have three (fixed values of the international numbering plan).
_CODES_1 = ("1", "7")
_CODES_2 = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _ranked(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """The places of a mixed radix permuted as one number."""
    n, size = 0, 1
    for v, s in zip(values, sizes):
        n, size = n * s + v, size * s
    n = feistel.permute(n, size, key, tweak)
    out = []
    for s in reversed(sizes):
        n, v = divmod(n, s)
        out.append(v)
    return out[::-1]


def _national(digits: str, country: str, key: bytes) -> str:
    """The digits after country and trunk prefix, permuted among numbers of the same length that may exist.

    Numbers of country 1 keep to areas and exchanges from 2 on; others do not begin with 0.
    """
    if country == "1" and len(digits) == 10 and digits[0] > "1" and digits[3] > "1":
        a, e, n = _ranked([int(digits[:3]) - 200, int(digits[3:6]) - 200, int(digits[6:])], [800, 800, 10_000], key, "phone|1")
        return f"{a + 200}{e + 200}{n:04d}"
    if digits and digits[0] != "0":
        first, rest = _ranked([int(digits[0]) - 1, int(digits[1:] or 0)], [9, 10 ** (len(digits) - 1)], key, f"phone|{country}")
        return f"{first + 1}{rest:0{len(digits) - 1}d}" if len(digits) > 1 else str(first + 1)
    return feistel.permute_text(digits, key, f"phone|{country}")


def _phone(v: str, key: bytes) -> str:
    """The national digits permuted; prefixes, a trunk 0 and an extension stay, so all spellings of a number agree."""
    ext = re.search(r"(?:ext|x|extension|poste|durchwahl)\.?\s?\d{1,5}$", v, re.I)
    body, tail = (v[: ext.start()], v[ext.start() :]) if ext else (v, "")
    at = [i for i, c in enumerate(body) if c.isdigit()]
    digits = "".join(body[i] for i in at)
    if body[:1] == "+" or digits[:2] == "00":
        start = 0 if body[:1] == "+" else 2
        rest = digits[start:]
        country = next((c for c in (*_CODES_1, *_CODES_2) if rest.startswith(c)), rest[:3])
        keep = start + len(country)
        if (m := re.search(r"\(0\)", body)) and at.index(m.start() + 1) == keep:  # the trunk 0 that is not dialled from abroad
            keep += 1
    elif len(digits) == 10 and digits[0] > "1" or len(digits) == 11 and digits[0] == "1":
        country, keep = "1", len(digits) - 10
    else:
        country, keep = "0", 1 if digits[0] == "0" else 0
    new = digits[:keep] + _national(digits[keep:], country, key)
    out = list(body)
    for i, d in zip(at, new):
        out[i] = d
    return "".join(out) + tail


#: Letters and prefixes that national insurance numbers use, and the check letters of Spanish numbers (fixed values).
_NINO_1, _NINO_2 = "ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ"
_NINO_NOT = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
_NINO = [a + b for a in _NINO_1 for b in _NINO_2 if a + b not in _NINO_NOT]
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
_DEPARTMENTS = [f"{i:02d}" for i in range(1, 20)] + ["2A", "2B"] + [f"{i:02d}" for i in range(21, 96)]


def _nir_check(body: str) -> int:
    return 97 - int(body.replace("2A", "19").replace("2B", "18") if body[5:7] in ("2A", "2B") else body) % 97


def _canonical_id(flat: str, key: bytes) -> str | None:
    """A valid number of a known format as another valid one of it; null if it is none of these."""
    if re.fullmatch(r"\d{9}", flat) and flat[:3] not in ("000", "666") and flat[0] != "9" and flat[3:5] != "00" and flat[5:] != "0000":
        area = int(flat[:3]) - 1 - (flat[:3] > "666")
        a, g, n = _ranked([area, int(flat[3:5]) - 1, int(flat[5:]) - 1], [898, 99, 9999], key, "ssn")
        a += 1 + (a >= 665)
        return f"{a:03d}{g + 1:02d}{n + 1:04d}"
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", flat):
        if flat[:2] in _NINO:
            p, n, s = _ranked([_NINO.index(flat[:2]), int(flat[2:8]), "ABCD".index(flat[8])], [len(_NINO), 10**6, 4], key, "nino")
            return f"{_NINO[p]}{n:06d}{'ABCD'[s]}"
        n, s = _ranked([int(flat[2:8]), "ABCD".index(flat[8])], [10**6, 4], key, "nino" + flat[:2])  # a prefix that is not issued stays
        return f"{flat[:2]}{n:06d}{'ABCD'[s]}"
    if re.fullmatch(r"[12]\d{4}(?:\d\d|2[AB])\d{8}", flat) and flat[5:7] in _DEPARTMENTS and "01" <= flat[3:5] <= "12" and 1 <= int(flat[7:10]) <= 990 and flat[10:13] != "000" and int(flat[13:]) == _nir_check(flat[:13]):
        sizes = [100, 12, len(_DEPARTMENTS), 990, 999]
        y, m, d, c, o = _ranked([int(flat[1:3]), int(flat[3:5]) - 1, _DEPARTMENTS.index(flat[5:7]), int(flat[7:10]) - 1, int(flat[10:13]) - 1], sizes, key, "nir")
        body = f"{flat[0]}{y:02d}{m + 1:02d}{_DEPARTMENTS[d]}{c + 1:03d}{o + 1:03d}"
        return f"{body}{_nir_check(body):02d}"
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", flat) and len(flat) == 9:
        head = flat[0] if flat[0] in "XYZ" else ""
        digits = flat[len(head) : 8]
        number = lambda d: int(("0" if not head else str("XYZ".index(head))) + d)
        if _DNI[number(digits) % 23] == flat[8]:
            new = feistel.permute_text(digits, key, "dni" + head)
            return f"{head}{new}{_DNI[number(new) % 23]}"
    if re.fullmatch(r"DL\d{9}", flat):
        return "DL" + feistel.permute_text(flat[2:], key, "dl")
    return None


def _id_number(v: str, key: bytes) -> str:
    flat = re.sub(r"[^0-9A-Za-z]", "", v).upper()
    new = _canonical_id(flat, key) or feistel.permute_text(flat, key, "id")
    it = iter(new)
    return "".join(next(it) if re.match(r"[0-9A-Za-z]", c) else c for c in v)


def _account(v: str, kind: str, key: bytes) -> str:
    """An account of the same country, or a card of the same issuer, whose check digits fit."""
    flat = re.sub(r"[^0-9A-Z]", "", v)
    if kind == "iban":
        body = feistel.permute_text(flat[4:], key, "iban" + flat[:2])
        new = f"{flat[:2]}{98 - _iban_rest(flat[:2] + '00' + body):02d}{body}"
    else:
        body = flat[:6] + feistel.permute_text(flat[6:-1], key, "card" + flat[:6])
        new = body + str(-_luhn(body + "0") % 10)
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in v)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a value; equal values have equal ones."""
    if kind == "phone":
        return f"[PHONE {_phone(value, key)}]"
    if kind == "id_number":
        return f"[ID_NUMBER {_id_number(value, key)}]"
    if kind in ("iban", "card"):
        return f"[{kind.upper()} {_account(value, kind, key)}]"
    if kind == "birth_date":
        day = feistel.permute_date(_date(value), key)
        return f"[BIRTH_DATE {day.isoformat() if value[4:5] == '-' else day.strftime('%d.%m.%Y')}]"
    flat = re.sub(r"\W+", " ", value.lower()).strip()
    if kind == "email":
        flat = re.sub(r"\s", "", re.sub(_AT + r"|\s+at\s+", "@", re.sub(_DOT, ".", value.lower().removeprefix("mailto:"), flags=re.I), count=1, flags=re.I))
    if kind == "person":
        flat = re.sub(rf"^(?:{_TITLE})\s", "", flat)
        if "," in value:
            flat = " ".join(reversed(flat.split(" ", 1)))
    return f"[{kind.upper()} {feistel.token(flat, key)}]"


def pseudonyms(text: str | None, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, placeholder) of the personal information in a text."""
    return [(a, b, kind, placeholder(kind, text[a:b], key)) for a, b, kind in find(text)]


def redact(text: str | None, key: bytes) -> str | None:
    return redact_spans(text, key)[0]


def redact_spans(text: str | None, key: bytes) -> tuple[str | None, int]:
    """The redacted text and the number of replaced spans."""
    spans = pseudonyms(text, key)
    if not spans:
        return text, 0
    out, at = [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], len(spans)


_VALUES = "record_key string, kind string, pseudonym string, spans int"


def _values(key: bytes):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf["record_key"], pdf["text"]):
                n: dict[tuple[str, str], int] = {}
                for _, _, kind, new in pseudonyms(text, key):
                    n[kind, new] = n.get((kind, new), 0) + 1
                rows += [(k, kind, new, m) for (kind, new), m in n.items()]
            yield pd.DataFrame(rows, columns=["record_key", "kind", "pseudonym", "spans"])

    return f


def values(df: DataFrame, key_col: str, text_col: str, key: bytes) -> DataFrame:
    """(record_key, kind, pseudonym, spans): what each record holds, equal values under equal pseudonyms; null keys are left out."""
    slim = df.select(F.col(key_col).alias("record_key"), F.col(text_col).alias("text")).where("record_key IS NOT NULL AND text IS NOT NULL")
    return slim.mapInPandas(_values(key), _VALUES)


def records_with(df: DataFrame, key_col: str, text_col: str, key: bytes = b"kinds") -> DataFrame:
    """(record_key, kind): which kinds the text of each record holds; null keys are left out."""
    return values(df, key_col, text_col, key).where(F.col("kind").isin(*KINDS)).select("record_key", "kind").distinct()


def redact_column(df: DataFrame, text_col: str, key: bytes, out_col: str = "redacted") -> DataFrame:
    """``df`` with the redacted text and the number of replaced spans."""

    @F.pandas_udf("text string, spans int")
    def f(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([redact_spans(t, key) for t in texts], columns=["text", "spans"])

    return df.withColumn("_r", f(F.col(text_col))).withColumn(out_col, F.col("_r.text")).withColumn("pii_spans", F.col("_r.spans")).drop("_r")

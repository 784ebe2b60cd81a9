"""Personal information inside free text, found and replaced by typed placeholders.

Offset-preserving deobfuscation: small transducers rewrite what is disguised
(look-alike letters and full-width signs, invisible characters, digits spelled as
words, "at" and "dot" in words or brackets) and keep, for every character of the
normal form, its place in the source. Identifiers are detected in the normal form
and their spans are mapped back, so that the rest of the text stays as it was.

Kinds: ``email``, ``phone``, ``id_number`` (tax, social insurance, passport,
identity card, driving licence), ``address`` (with a house number), ``person`` (a
name with first name or title). A person is told by a title, by a first name of the
lists, or, whatever the name, by what stands around two capitalised words: a lead that
only persons have, what only persons do, or weaker signs on both sides. Where spans
overlap, the earlier kind of this order holds: email, id_number, phone, address, person.

Defined results: null texts give no spans and stay null; texts of any length are
read whole; repeated rows give the same result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "id_number", "phone", "address", "person")

# Fixed values -------------------------------------------------------------------

LOOKALIKES = dict(zip("АВЕЗКМНОРСТУХаеосрухіјѕԁһɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν", "ABE3KMHOPCTYXaeocpyxijsdhgABEZHIKMNOPTYXaopv"))
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"　": " ", "∙": ".", "․": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "−": "-"}
LOOKALIKES |= {chr(first + i): chr(ord("0") + i) for first in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
INVISIBLE = "\xad​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
AT_WORDS = "at|ät|arroba|arobase|klammeraffe|chez"
DOT_WORDS = "dot|punkt|point|punto"
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Sir Herr Herrn Frau Fräulein Mme Mlle Me Maître Monsieur Madame Sr Sra Srta Señor Señora Don Doña Dña Dra".split()
GIVEN = """
Adam Alan Alice Amelia Andrew Anna Anne Anthony Barbara Benjamin Brian Catherine Charles Charlotte Christine Christopher Claire Daniel David Diana Edward
Eleanor Elizabeth Emily Emma Eric Ethan Frances Frank George Grace Hannah Harry Helen Henry Isabel Jack Jacob James Jane Janet Jason Jennifer Jessica John
Jonathan Joseph Julia Karen Kate Keith Kevin Laura Liam Linda Louise Lucy Margaret Maria Mark Martin Mary Matthew Megan Michael Michelle Nancy Natalie
Nicholas Nicole Oliver Olivia Patricia Patrick Paul Peter Philip Rachel Rebecca Richard Robert Rose Ruth Samuel Sarah Simon Sophie Stephen Steven Susan
Thomas Timothy Victoria William
Andreas Angelika Annette Bernd Birgit Christian Claudia Dieter Dirk Felix Florian Greta Hans Heike Heinrich Ingrid Jan Jens Johannes Jonas Jörg Jürgen
Karin Katharina Klaus Lena Lukas Manfred Markus Matthias Monika Petra Ralf Renate Sabine Sebastian Stefan Susanne Sven Tobias Ulrike Ursula Uwe Wolfgang
""".split()
MORE_GIVEN = """
Adèle Alain Amélie André Antoine Aurélie Bastien Béatrice Benoît Bernard Brigitte Camille Cécile Céline Chloé Christophe Clément Damien Denis Élise Élodie
Émilie Étienne Fabien François Françoise Gérard Guillaume Hélène Hugo Inès Isabelle Jacques Jean Jérôme Julien Juliette Laurent Léa Louis Lucie Manon Marc
Margaux Marie Mathieu Mathilde Nathalie Nicolas Olivier Pascal Philippe Pierre Quentin Romain Sandrine Sébastien Sophie Stéphane Sylvie Théo Thierry
Valérie Véronique Vincent Yves
Adriana Alberto Alejandra Alejandro Alfonso Alicia Álvaro Ana Andrés Ángel Antonio Beatriz Carlos Carmen Carolina Cristina Diego Eduardo Elena Enrique
Esteban Fernando Francisco Gabriela Gonzalo Guillermo Inés Ignacio Javier Jesús Joaquín Jorge José Josefa Juan Julio Leticia Lorena Lucía Luis Manuel
Marcos Marta Mercedes Miguel Mónica Natalia Pablo Patricia Paula Pedro Pilar Rafael Raquel Raúl Ricardo Roberto Rosa Rubén Santiago Sara Sergio Silvia
Sofía Susana Teresa Tomás Vicente Víctor Ximena
""".split()
#: Capitalised words that follow a title or first name without being a surname.
NOT_SURNAMES = set(
    """the this that these those if each any all after before when where unless for from on in at by to and or of with no not neither we you they he she it
    period street road lane avenue court day days date note notice section clause schedule article part term terms act bill law agreement order city county
    island church school college university hospital bridge station river lake route company corporation group holdings bank park hall house inc ltd llc plc
    gmbh ag kg se sa sarl platform facility network programme services software materials records works goods systems januar februar märz april mai juni juli
    august september oktober november dezember january february march may june july october december der die das den dem ein eine und oder nach vor bei le la
    les un une des et ou el los las una y o""".split()
)
COMPANY = r"(?:Inc|Ltd|LLC|plc|PLC|AG|GmbH|KG|SE|SA|SARL|SAS|S\.A\.|S\.L\.|Corp|Co|Holdings|Group|& Co|and Sons|& Sons)\b"
ID_WORDS = [
    r"ssn", r"social security (?:number|no\.?)?", r"social insurance (?:number|no\.?)", r"tax (?:id|identification|payer)(?: number| no\.?)?", r"itin\b", r"national insurance(?: number| no\.?)?", r"ni (?:number|no\.?)", r"nino\b",
    r"passport(?: number| no\.?)?", r"driv(?:er'?s?|er’s|ing) licen[cs]e(?: number| no\.?)?", r"identity card(?: number| no\.?)?", r"id card(?: number| no\.?)?",
    r"steuer-?id(?:entifikationsnummer|-nr\.?)?", r"steuernummer", r"sozialversicherungs(?:nummer|-nr\.?)", r"rentenversicherungsnummer", r"(?:personal)?ausweis(?:nummer|-nr\.?| nr\.?)", r"reisepass(?:nummer|-nr\.?)?", r"führerschein(?:nummer|-nr\.?)?",
    r"nir\b", r"num[ée]ro de s[ée]curit[ée] sociale", r"n[°o] de s[ée]curit[ée] sociale", r"s[ée]curit[ée] sociale", r"num[ée]ro fiscal", r"carte (?:nationale )?d['’]identit[ée]", r"passeport", r"permis de conduire",
    r"d\.?n\.?i\b\.?", r"n\.?i\.?e\b\.?", r"n\.?i\.?f\b\.?", r"pasaporte", r"(?:n[úu]mero de (?:la )?)?seguridad social", r"(?:permiso|carn[ée]) de conducir",
]
STREETS = {
    "en": r"(?:street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|drive|close|court|way|square|sq|place|terrace|crescent|gardens|grove|mews|parkway|highway)",
    "de": r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|chaussee|steig)",
    "fr": r"(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|cours|passage|ruelle|square)",
    "es": r"(?:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|camino|carretera|ronda|travesía)",
}

# Transducers --------------------------------------------------------------------


def _any_of(words) -> str:
    """A pattern for any of the words that branches letter by letter."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        ends = "" in node
        parts = [re.escape(c) + build(n) for c, n in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else "(?:" + "|".join(parts) + ")"
        return body + ("?" if ends else "")

    return build(tree)


_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "]")
_DIGIT_RUN = re.compile(rf"{_any_of(DIGIT_WORDS)}(?:[\s,.-]{{1,3}}(?:double |triple )?{_any_of(DIGIT_WORDS)}){{5,}}\b")
_DIGIT_WORD = re.compile(r"[^\W\d_]+")
_AT = re.compile(rf"\s*[\[({{<]\s*(?:{AT_WORDS}|a)\s*[\])}}>]\s*|(?:&#64;|%40)|\s+(?:{AT_WORDS})\s+(?=[\w-]+(?:\s+[\w-]+)?\s*(?:[\[({{]\s*(?:{DOT_WORDS})\s*[\])}}]|\s(?:{DOT_WORDS})\s))")
_HOST = re.compile(r"[\w.-]*")
_DOT = re.compile(rf"\s*[\[({{<]\s*(?:{DOT_WORDS}|\.)\s*[\])}}>]\s*|\s+(?:{DOT_WORDS})\s+")
#: One of these stands in every text in which an "at" is disguised.
_HINTS = ("at)", "at]", "at}", "at>", "at )", "at ]", "ät)", "ät]", "(a)", "[a]", "{a}", "arroba", "arobase", "klammeraffe", "chez", "&#64;", "%40", *(f"{c}{w}{d}" for w in DOT_WORDS.split("|") for c, d in ((" ", " "), ("(", ")"), ("[", "]"))))


def _odd(text: str) -> bool:
    """Whether there may be look-alikes or invisible characters."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD.search(text) is not None
    return "\xad" in text


class Normal:
    """A text in normal form, and where its characters come from."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.by = text, [0], [0]  # normal offsets, source offsets
        self.spelled: list[tuple[int, int]] = []
        self.numbers: list[tuple[int, int]] = []
        if _odd(text):
            self._rewrite([(m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _ODD.finditer(self.text)])
        low = self.text.lower()
        if len(low) != len(self.text):  # a letter whose small form is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in self.text)
        edits = []
        for m in _DIGIT_RUN.finditer(low):
            if m.start() and low[m.start() - 1].isalnum():
                continue
            digits, times = "", 1
            for w in _DIGIT_WORD.findall(m[0]):
                if w in ("double", "triple"):
                    times = 2 if w == "double" else 3
                else:
                    digits, times = digits + str(DIGIT_WORDS[w]) * times, 1
            edits.append((m.start(), m.end(), digits))
        if any(h in low for h in _HINTS):
            for m in _AT.finditer(low):
                edits.append((m.start(), m.end(), "@"))
                # The dots that follow, as far as the address goes.
                past = m.end()
                while d := _DOT.match(low, _HOST.match(low, past).end()):
                    edits.append((d.start(), d.end(), "."))
                    past = d.end()
        self.low = low
        if edits:
            self._rewrite(sorted(edits), True)
            self.low = self.text.lower() if len(self.text.lower()) == len(self.text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in self.text)

    def _rewrite(self, edits: list[tuple[int, int, str]], mark: bool = False) -> None:
        out, at, by, last, size = [], [0], [self.source(0)], 0, 0
        old = list(zip(self.at, self.by))
        k = 0

        def keep(until: int) -> None:
            """Copies a stretch, with the places where the text had been rewritten before."""
            nonlocal k, size
            out.append(self.text[last:until])
            while k < len(old) and old[k][0] <= until:
                if old[k][0] >= last:
                    at.append(size + old[k][0] - last)
                    by.append(old[k][1])
                k += 1
            size += until - last

        for first, past, new in edits:
            if first < last:
                continue
            keep(first)
            if mark and new.isdigit() and 7 <= len(new) <= 15:
                self.spelled.append((size, size + len(new)))
            for i in range(len(new)):
                at.append(size + i)
                by.append(self.source(first + min(i, past - first - 1)))
            out.append(new)
            size += len(new)
            last = past
            at.append(size)
            by.append(self.source(past))
            while k < len(old) and old[k][0] <= past:
                k += 1
        keep(len(self.text))
        self.text, self.at, self.by = "".join(out), at, by

    def source(self, i: int) -> int:
        k = bisect_right(self.at, i) - 1
        return self.by[k] + i - self.at[k]

    def span(self, first: int, past: int) -> tuple[int, int]:
        """The span in the source; its end is that of its last character, so a
        replacement shorter than what it stands for is taken whole."""
        k = bisect_right(self.at, past) - 1
        end = self.by[k] if self.at[k] == past else self.source(past - 1) + 1
        return self.source(first), max(end, self.source(past - 1) + 1)


# Detectors ----------------------------------------------------------------------

#: Marks within the part of an address before the "@".
_LOCAL_MARKS = frozenset("_.+%'-")
#: A stretch of so many characters, white space not counted.
_NEAR, _NEARER = re.compile(r"(?:\s*\S){0,48}\s*"), re.compile(r"(?:\s*\S){0,16}\s*")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}\b")
_EXT = r"(?:\s*(?:ext\.?|extension|x|durchwahl|poste)\s*\d{1,5}\b)?"
_PHONE = re.compile(
    r"(?<![\w+.,/#-])(?:"
    r"\(?\+\d{1,3}\)?[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){5,12}"
    r"|(?<!\d[ ])00[1-9]\d{0,2}[ .\-/]?(?:\(0\)[ .\-/]?)?\d(?:[ .\-/]?\d){6,12}"
    r"|(?<!\d[ ])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.\- ])[2-9]\d{2}[.\- ]\d{4}"
    r"|(?<!\d[ ])0\d{2}[ \-]\d{4}[ \-]\d{4}|(?<!\d[ ])0\d{3}[ \-]\d{3}[ \-]\d{4}|(?<!\d[ ])0[1-9]\d{3}[ \-]\d{6}"
    r"|(?<!\d[ ])\(0\d{1,4}\) ?\d{3,5}[ \-/]?\d{2,6}"
    r"|(?<!\d[ ])0[1-9]\d{0,3}[/\-]\d{4,8}(?:-\d{1,5})?|(?<!\d[ ])0[1-9]\d{1,3} \d{4,8}(?:[ \-]\d{1,5})?"
    r"|(?<!\d[ ])0[1-9](?:[ .\-]\d{2}){4}"
    r"|(?<!\d[ ])[6789]\d{2}(?:(?:[ .\-]\d{3}){2}|(?:[ .\-]\d{2}){3})"
    rf"){_EXT}(?![\w/])(?![.\-,]\d)",
    re.IGNORECASE,
)
_NUMBER = re.compile(r"[\d+(][\d .()/+\-]{5,}\d")
_CUE = re.compile(r"\b(?:tel|tél|telefon|teléfono|téléphone|phone|mobile|mobil|móvil|call|fax|llame al|joindre le|handy)\b\.?:?\s*(?:is |unter |at )?$")
_MONEY = re.compile(r"(?:EUR|USD|GBP|INR|CHF|€|\$|£)\s?$")
_MONEY_AFTER = re.compile(r"\s?(?:EUR|USD|GBP|INR|CHF|€|\$|£)")
_ID = re.compile(r"\b(?:" + "|".join(ID_WORDS) + r")(?:\s*(?:number|n[°ºo]\.?|nr\.?|num\.?|número|numéro|#|:|=|-|is|ist|es|est)){0,3}\s*", re.IGNORECASE)
_ID_VALUE = re.compile(r"[A-Z]{0,3}\d*[A-Z]?\d*(?:[ .\-/](?:\d+[A-Z]{0,2}|[A-Z]\d*)\b){0,7}")
_PLAIN_ID = re.compile(r"\d{3}-\d{2}-\d{4}$")
_INSURED = re.compile(r"[A-Z][A-Z] ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)")
#: One of these stands in whatever the patterns for numbered documents match.
_ID_HINTS = ("ssn", "social security", "social insurance", "tax id", "tax payer", "itin", "insurance", "ni n", "nino", "passport", "licence", "license", "identity card", "id card", "steuer-", "steuerid", "steuernummer", "versicherungs", "ausweis", "reisepass", "führerschein", "nir", "sociale", "fiscal", "identit", "passeport", "permis", "dni", "d.n.i", "nie", "n.i.e", "nif", "n.i.f", "pasaporte", "seguridad social", "conducir")
_TOWN = r"(?:,?\s+(?:apt\.?|flat|suite|unit)\s*\w+)?(?:,?\s+(?-i:(?:Port |Bad |Saint-|San |St\. )?[A-ZÀ-Þ][\w'’-]+)(?=,?\s+(?:\d{5}|[a-z]{1,2}\d{1,2}[a-z]?\s?\d[a-z]{2})\b))?(?:,?\s+(?:\d{5}(?:\s+(?-i:[A-ZÀ-Þ][\w'’-]+))?|(?-i:[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}))\b)?"
def _cases(pattern: str) -> str:
    words = [w for w in pattern[3:-1].split("|")]
    return "(?:" + "|".join(sorted({v for w in words for v in (w, w.title(), w.upper())}, reverse=True)) + ")"


_NUMBERED = re.compile(
    rf"\d+(?:[A-Za-z]|\s?(?:bis|ter|quater))?(?:-\d{{1,4}})?,?\s+(?:(?:(?:[A-ZÀ-Þ][\w'’.-]*|\d+(?:st|nd|rd|th))\s+){{1,4}}{_cases(STREETS['en'])}\b\.?"
    rf"|{_cases(STREETS['fr'])}\s+(?:(?:de la|de l['’]|des|de|du|d['’])\s?)?[A-ZÀ-Þ][\w'’-]+)"
)
_FLAT = re.compile(r"(?:flat|apt\.?|unit|suite)\s*\d+\w?,\s*$", re.IGNORECASE)
_REST = re.compile(_TOWN, re.IGNORECASE)
_STREET_ES = re.compile(
    rf"{STREETS['es']}\s*(?:(?:de la|de los|de las|del|de)\s+)?(?-i:[A-ZÀ-Þ])[\w'’-]+(?:\s+(?-i:[A-ZÀ-Þ])[\w'’-]+)?,?\s*(?:n[.º°úu]*(?:mero)?\s*)?\d{{1,4}}\b(?:,\s*\d+\.?[ºª]\s*\w?)?{_TOWN}",
    re.IGNORECASE,
)
_ES_HINTS = ("calle", "c/", "avda", "avenida", "plaza", "pza", "paseo", "camino", "carretera", "ronda", "travesía")
_DE_HINTS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "chaussee", "steig")
_NUMBER_DE = re.compile(r"\s+\d{1,4}(?:\s?[A-Za-z])?\b(?:,?\s+\d{5}\s+[^\W\d_][\w-]*)?")
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]+)?"
_SUR = rf"(?:(?:von|van|de|del|di|du|la|le|der|zu|O['’]|Mc|Mac)\s?)*{_NAME}"
_FIRST = _any_of(sorted(set(GIVEN + MORE_GIVEN)))
_LEAD = re.compile(_any_of(sorted({*GIVEN, *MORE_GIVEN, *TITLES, "M.", "D."} | {w.upper() for w in GIVEN + MORE_GIVEN})))
_TITLES = {*TITLES}
_ALL_GIVEN = {*GIVEN, *MORE_GIVEN}
_AFTER_TITLE = re.compile(rf"\.?\s+(?:(?:{_any_of(TITLES)})\.?\s+)?(?:{_NAME}\s+)?(?:[A-Z]\.\s?)?({_SUR})")
_TITLE_ONLY = re.compile(rf"\.?\s+(?:(?:{_any_of(TITLES)})\.?\s+)?(?:[A-Z]\.\s?)?({_SUR})")
_D_ONLY = re.compile(rf"\s+({_SUR})")
_BEFORE_D = re.compile(r"(?:[:(,]|\b(?:según|a|de|con|por|para|y|e))\s+$")
_AFTER_D = re.compile(rf"\s+{_FIRST}\s+(?:[A-Z]\.\s?)?({_SUR})")
_AFTER_GIVEN = re.compile(rf"(?:-{_FIRST})?\s+(?:[A-Z]\.\s?)?({_SUR})")
_AFTER_LOUD = re.compile(r"\s+(?:[A-Z]\.\s)?([A-ZÀ-Þ]{3,}(?:-[A-ZÀ-Þ]{3,})?)(?!\w)")
_BEFORE_COMMA = re.compile(rf"{_NAME},\s")
_INITIAL = re.compile(r"\s+[A-Z]\.(?=\s)")
_FIRM = re.compile(rf"(?:\s+[A-Z]\w+)?,?\s+{COMPANY}")
_DIGITS = re.compile(r"\d")
# Names that no list holds are told by what stands around them. Words that
# lead in a person, in the four languages; words that may lead in a company as well; what
# only persons do; what persons and companies do.
LEADS = set(
    """dear hi hello regards, sincerely, cheers, signed: signed attn. attn: attention: from: to: cc: bcc: author: witness: name: contact: gezeichnet: gez. von: an:
    ansprechpartner: ansprechpartnerin: hallo liebe lieber name: zeuge: grüßen, signé: contact: auteur: témoin: bonjour chère cher cordialement, firmado: contacto: autor: testigo:
    hola querida querido estimada estimado atentamente, nombre:""".split()
) | {
    "spoke with", "spoke to", "speak with", "speak to", "talked with", "talked to", "talk to", "met with", "meet with", "meeting with", "interview with", "interviewed", "named", "signed by", "witnessed by", "written by", "reported by", "handed to",
    "witness details:", "my colleague", "our colleague", "his wife", "her husband", "ansprechpartner ist", "ansprechpartnerin ist", "gespräch mit", "gesprochen mit", "sprach mit", "spreche mit", "telefonat mit", "kollege", "kollegin", "schlüssel bekam",
    "parlé avec", "parlé à", "parler à", "entretien avec", "collègue", "remises à", "hablé con", "hablado con", "hablar con", "reunión con", "entregaron a", "colega",
}
WEAK_LEADS = {"according to", "delivery for", "verify that", "go to", "sent by", "approved by", "prepared by", "reviewed by", "call", "ask", "asked", "told", "laut", "auskunft von", "post für", "selon", "según"}
DOES = {"lives", "lived", "resides", "ever", "wohnt", "wohnte", "habite", "habitait", "vive", "vivía", "reside", "phoned", "smiled", "retired", "née", "born", "geboren", "né", "nacida", "nacido"}
MAY_DO = {"said", "says", "wrote", "writes", "asked", "told", "called", "replied", "answered", "thinks", "confirmed", "signed", "gave", "nobody", "sagte", "schrieb", "hat", "bestätigte", "fragte", "a", "écrit", "dit", "confirme", "dijo", "escribió", "confirmó", "firmó", "aprobó", "reachable", "tel", "tel.", "tél.", "phone"}
_TWO_NAMES = re.compile(rf"(?<![\w-])({_NAME})\s+(?:[A-Z]\.\s?)?({_SUR})(?![\w-])")
_CONTACT = re.compile(r"\s*[,/:]?\s*[<(]?\s*(?:mailto:)?[\w.+%'-]+@")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    at = t.find("@")
    while at >= 0:
        first = at
        while first and (t[first - 1].isalnum() or t[first - 1] in _LOCAL_MARKS):
            first -= 1
        domain = _DOMAIN.match(t, at + 1)
        if first < at and domain and (t[at - 1].isalnum() or t[at - 1] == "_"):
            yield first, domain.end()
        at = t.find("@", at + 1)


def _hits(low: str, words: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Where any of the words stands, first and past."""
    for w in words:
        i = low.find(w)
        while i >= 0:
            yield i, i + len(w)
            i = low.find(w, i + 1)


def _id_numbers(n: Normal) -> Iterator[tuple[int, int]]:
    t, seen = n.text, set()
    for i, j in _hits(n.low, _ID_HINTS):
        for m in _ID.finditer(t, max(0, i - 32), _NEAR.match(t, j).end()):
            if m.end() not in seen:
                seen.add(m.end())
                v = _ID_VALUE.match(t, m.end())
                if v and len(_DIGITS.findall(v[0])) >= 5:
                    yield v.span()
    for m in _INSURED.finditer(t):
        if not (m.start() and t[m.start() - 1].isalnum()):
            yield m.span()
    for a, b in n.numbers:
        m = _PLAIN_ID.search(t, a, b)
        if m and (m.start() == a or not (t[m.start() - 1].isalnum() or t[m.start() - 1] == "-")) and not t[b : b + 1].isalnum() and t[b : b + 1] != "-":
            yield m.span()


def _phones(n: Normal) -> Iterator[tuple[int, int]]:
    t = n.text
    for a, b in n.numbers:
        found = False
        for m in _PHONE.finditer(t, a, _NEARER.match(t, b).end()):
            if m.start() >= b:
                break
            if not (_MONEY.search(t, max(0, m.start() - 5), m.start()) or _MONEY_AFTER.match(t, m.end())):
                found = True
                yield m.span()
        if not found and 7 <= b - a <= 12 and t[a:b].isdigit() and _CUE.search(n.low, max(0, a - 24), a):
            yield a, b
    yield from n.spelled


def _addresses(n: Normal) -> Iterator[tuple[int, int]]:
    t = n.text
    for m in _NUMBERED.finditer(t):
        a = m.start()
        if a and (t[a - 1].isalnum() or t[a - 1] in "._"):
            continue
        flat = _FLAT.search(t, max(0, a - 16), a)
        yield (flat.start() if flat else a), _REST.match(t, m.end()).end()
    for i, _ in _hits(n.low, _ES_HINTS):
        if not (i and t[i - 1].isalnum()) and (m := _STREET_ES.match(t, i)):
            yield m.span()
    for i, j in _hits(n.low, _DE_HINTS):
        if t[j : j + 1].isspace() and (m := _NUMBER_DE.match(t, j)):
            while i and (t[i - 1].isalpha() or t[i - 1] == "-"):
                i -= 1
            if t[i].isupper():
                yield i, m.end()


def _persons(n: Normal) -> Iterator[tuple[int, int]]:
    t = n.text
    for lead in _LEAD.finditer(t):
        a, b = lead.span()
        word = lead[0]
        if a and (t[a - 1].isalnum() or t[a - 1] == "-") or (word[-1] != "." and b < len(t) and (t[b].isalnum() or t[b] == "_")):
            continue
        given = word in _ALL_GIVEN
        if given:
            m = _AFTER_GIVEN.match(t, b)
        elif word == "D.":
            m = _AFTER_D.match(t, b) or (_BEFORE_D.search(n.low, max(0, a - 8), a) and _D_ONLY.match(t, b))
        elif word == "M." or not word.isupper():
            m = _AFTER_TITLE.match(t, b)
            if m and m[1].split()[-1].lower() in NOT_SURNAMES:
                m = _TITLE_ONLY.match(t, b)
        else:
            m = _AFTER_LOUD.match(t, b)
        if m and m[1].split()[-1].lower() not in NOT_SURNAMES and not _FIRM.match(t, m.end()):
            yield a, m.end()
        elif given and t[a - 2 : a - 1] == "," and not (t[b : b + 1] == "-" and t[b + 1 : b + 2].isdigit()):
            first = a - 2
            while first and (t[first - 1].isalpha() or t[first - 1] in "'’-"):
                first -= 1
            if _BEFORE_COMMA.fullmatch(t, first, a) and t[first : a - 2].lower() not in NOT_SURNAMES and not _FIRM.match(t, b):
                more = _INITIAL.match(t, b)
                yield first, more.end() if more else b


def _lead(low: str, at: int) -> int:
    """2 if what stands before leads in a person, 1 if a person or a company, else 0."""
    before = low[max(0, at - 40) : at].split()
    if before and before[-1] == ":":
        before[-2:] = ["".join(before[-2:])]
    one, two = before[-1:] or [""], " ".join(before[-2:])
    return 2 if one[0] in LEADS or two in LEADS else int(one[0] in WEAK_LEADS or two in WEAK_LEADS)


def _named_by_context(n: Normal) -> Iterator[tuple[int, int]]:
    """Two capitalised words in a place for persons: a lead that only persons have, or what
    only persons do after it, or a weaker sign on both sides."""
    t, m = n.text, _TWO_NAMES.search(n.text)
    while m:
        first = m.span(1)
        words = m[1], m[2].split()[-1]
        if t[slice(*first)].lower() in LEADS or m[1] in _TITLES:  # the name begins with the next word
            m = _TWO_NAMES.search(t, first[1])
            continue
        if not any(w.lower() in NOT_SURNAMES or w in _TITLES for w in words) and not _FIRM.match(t, m.end()):
            lead = _lead(n.low, m.start())
            after = n.low[m.end() : m.end() + 24].lstrip(" ,:").split(None, 1)[:1] or [""]
            does = 2 if after[0] in DOES or _CONTACT.match(t, m.end()) else int(after[0] in MAY_DO or after[0][:1].isdigit() or after[0] in ("at", "flat"))
            if lead == 2 or does == 2 or lead and does:
                yield m.span()
        m = _TWO_NAMES.search(t, m.end())


def find(text: str) -> list[tuple[int, int, str]]:
    """(first, past, kind) of the spans in the source text, in order, none overlapping."""
    n = Normal(text)
    t = n.text
    n.numbers = [m.span() for m in _NUMBER.finditer(t)]
    firsts: list[int] = []
    taken: list[tuple[int, int, str]] = []  # in order, none overlapping
    for kind, spans in (("email", _emails(t)), ("id_number", _id_numbers(n)), ("phone", _phones(n)), ("address", _addresses(n)), ("person", _persons(n)), ("person", _named_by_context(n))):
        for a, b in spans:
            k = bisect_right(firsts, a)
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= firsts[k]):
                firsts.insert(k, a)
                taken.insert(k, (a, b, kind))
    return sorted((*n.span(a, b), kind) for a, b, kind in taken)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def scan(records: DataFrame, kind: str, id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """(rec_kind, rec_id, spans of (first, past, kind), and with ``with_text`` the
    redacted text) of every record."""
    rows = records.select(F.lit(kind).alias("rec_kind"), F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("kind", pa.string())]))
    schema = "rec_kind string, rec_id bigint, spans array<struct<first int, past int, kind string>>" + (", text string" if with_text else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [find(t) if t else [] for t in texts]
            cols = [b.column(0), b.column(1), pa.array([[{"first": x, "past": y, "kind": k} for x, y, k in f] for f in found], span)]
            if with_text:
                cols.append(pa.array([t if not f else redact(t, f) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["rec_kind", "rec_id", "spans", "text"][: len(cols)])

    return rows.mapInArrow(work, schema)

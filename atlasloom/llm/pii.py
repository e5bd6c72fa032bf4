"""Personal information inside free text: found, weighed and replaced by placeholders.

Regular expressions propose spans, started only where a cheap sign of them is (an automaton over given
names and street kinds, a digit run, an at sign). Check digits confirm numbers, words nearby raise or
lower the score, and a span counts from ``THRESHOLD`` on.

Names go by evidence. Sure contexts (titles, labels, signatures, contact data, verbs of persons) show
which words are given names and which follow them as family names; ``learn`` counts this over the whole
corpus with one aggregate of word pairs, and also which words are usual in small letters. The model is
bounded by parameters and small enough to be sent to the tasks.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: The greatest size of a learnt model, by part: the words with the most evidence stay.
MOST_GIVEN, MOST_FAMILY, MOST_ENDINGS, MOST_COMMON = 20_000, 100_000, 5_000, 50_000
#: How often given and family names are learnt from one another.
ROUNDS = 2
#: Pairs and words that a task counts before it passes them on.
HELD = 100_000

#: Given names that are usual in several countries, known before anything is learnt.
GIVEN = """
James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Donald Steven Andrew Paul Joshua
Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Scott Benjamin Samuel
Gregory Alexander Patrick Jack Dennis Peter Harry Oliver Mary Maria Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa
Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Dorothy
Amy Kathleen Angela Shirley Emma Brenda Anna Samantha Katherine Helen Rachel Olivia Sophie Charlotte Alice Hans Klaus Jürgen Stefan Wolfgang
Ursula Monika Sabine Petra Birgit Jean Pierre Philippe Michel François Marie Isabelle Nathalie Sylvie Camille Juan Antonio Carlos Luis
Miguel Javier Carmen Ana Teresa Pilar Giuseppe Giovanni Marco Francesco Giulia Chiara João Pedro Beatriz Jan Piotr Katarzyna Agnieszka
Lars Erik Ingrid Astrid Mohammed Ahmed Ali Fatima Aisha Wei Ming Hiroshi Kenji Yoko Raj Priyanka
Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Елена Ольга Наталья Татьяна Ирина Мария Анна Екатерина Γιώργος Δημήτρης Μαρία Ελένη
""".split()
#: Words that stand before a family name.
PARTICLE = r"(?:von der|von|van der|van den|van|de la|de los|del|della|de|da|di|der|den|dos|du|la|le|af|zu|ter|ten|bin|al)"
#: Kinds of streets, after the name (English), before it (Romance, Slavic) and as its end (Germanic).
STREET_EN = "Street St Road Rd Lane Ln Avenue Ave Court Ct Terrace Ter Drive Boulevard Blvd Way Close Crescent Place Square Row Grove Mews Parkway Pkwy Highway Hwy Trail Walk Gardens Quay".split()
STREET_PLAIN = "Walk Trail Gardens Quay Highway Gate".split()  # words of their own in small letters
STREET_ROMANCE = "rue avenue boulevard allée chemin impasse quai calle avenida paseo plaza camino rua travessa praça largo via viale piazza corso ulica aleja улица проспект".split()
STREET_SHORT = "c/ ul. al. ул. пр.".split()
STREET_GERMANIC = "straße strasse str. weg gasse allee platz ring damm ufer straat laan gatan vägen vej".split()
DIGIT_WORDS = "zero oh one two three four five six seven eight nine".split()
#: Labels of numbers that stand for a person, of phones, and words for keeping something private.
FOR_ID = re.compile(
    r"(?i)(?:\b(?:card|passport|licen[cs]e|permit|tax|social|security|national|identity|insurance|id|ssn|tin|nif|dni|cpf|nino|nhs|iban|account|document\w*|"
    r"file|form|record|holder|owner|citizen|person|ausweis\w*|steuer\w*|personal\w*|num[eé]ro|número|dossier|номер\w*|паспорт\w*|инн|снилс|forget|delete|remove|hide|redact)\b|番号|旅券)"
)
FOR_PHONE = re.compile(r"(?i)\b(?:phone|tel|telephone|mobile|cell|fax|call|ring|dial|reach|text|whatsapp|reads?|телефон\w*|téléphone|teléfono|telefon\w*)\b|電話|=$")
#: Words after a number that say that it is a person's.
AFTER_ID = re.compile(r"(?i)(?:\)|,)? ?(?:and [^\n]{4,24}|, [^\n]{0,3})?(?:are the same person|belongs to|is (?:his|her|my|their)\b)")
AGAINST = re.compile(r"(?i)(?:\b(?:serial(?: no\.?)?|order|invoice|batch|checksum|build|version|chapter|page|section|ratio|port|ticket|lot|after|isbn|rev(?:ision)?|part|item|sku|hash|commit)[\s:#]*|\bv)$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


class Model(NamedTuple):
    """What the corpus shows about words, all in one case: given names, family names and their endings, words usual in small letters."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    endings: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()

    def familiar(self, word: str) -> bool:
        """Whether ``word`` is a family name by what was seen of it or of its ending."""
        w = word.casefold()
        return w in self.family or (len(w) >= 5 and (w[-4:] in self.endings or w[-3:] in self.endings))


#: Nothing learnt yet.
PRIOR = Model()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(text: str) -> bool:
    """An account number with its country and check digits in front."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def dni(digits: str, letter: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter.upper()


def tax_id(digits: str) -> bool:
    """Eleven digits, the last by products modulo 11 and 10."""
    p = 10
    for c in digits[:10]:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(digits[10])


def with_key(digits: str) -> bool:
    """Thirteen digits with a key of two, modulo 97."""
    return 97 - int(digits[:13]) % 97 == int(digits[13:])


def cpf(digits: str) -> bool:
    for n in (9, 10):
        total = sum(int(c) * w for c, w in zip(digits, range(n + 1, 1, -1)))
        if int(digits[n]) != total * 10 % 11 % 10:
            return False
    return True


_B, _E = r"(?<![A-Za-z0-9_])(?<![0-9][.\-/])", r"(?![A-Za-z0-9_])(?![.\-/‑][0-9])"
_S = "[    ]"
_D = "[-‐‑–.  ]"
PHONES = [
    (0.9, re.compile(rf"\+\d{{1,3}}(?:{_S}|-|\.)?(?:\(0\){_S}?)?\d{{1,4}}(?:[-.  /]?\d{{2,6}}){{1,5}}{_E}")),
    (0.9, re.compile(rf"00\d{{2}}{_S}(?:\(0\){_S}?)?\d{{1,4}}(?:[-. /]\d{{2,6}}){{1,5}}{_E}")),
    (0.9, re.compile(rf"\(0?\d{{1,4}}\){_S}?\d{{3,4}}{_D}\d{{3,4}}{_E}")),
    (0.8, re.compile(rf"(?:1{_D})?\d{{3}}([-.‑])\d{{3}}\1\d{{4}}{_E}")),
    (0.6, re.compile(rf"1[2-9]\d\d[2-9]\d{{6}}{_E}")),
    (0.7, re.compile(rf"\d{{3}}[-‐‑]\d{{4}}{_E}")),
    (0.8, re.compile(rf"0\d(?:{_S}\d\d){{4}}{_E}")),
    (0.8, re.compile(rf"0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}{_E}")),
    (0.8, re.compile(rf"07\d{{3}}{_S}\d{{6}}{_E}")),
    (0.8, re.compile(rf"0\d{{2,4}}/\d{{3,6}}-\d{{2,4}}{_E}")),
]
#: Shapes of identity numbers with their score where nothing else speaks; what has check digits is weighed by them.
IDS = [
    (0.5, re.compile(rf"\d{{3}}-\d{{2}}-\d{{4}}{_E}")),
    (0.3, re.compile(rf"\d{{3}} \d{{2}} \d{{4}}{_E}")),
    (0.25, re.compile(rf"\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}{_E}")),
    (0.25, re.compile(rf"\d{{8}}-?[A-Z]{_E}")),
    (0.45, re.compile(rf"\d{_S}\d\d{_S}\d\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}(?:{_S}\d\d)?{_E}")),
    (0.25, re.compile(rf"\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}{_E}")),
    (0.1, re.compile(rf"\d{{9}}{_E}")),
    (0.05, re.compile(rf"\d{{11}}(?:\d\d(?:\d\d)?)?{_E}")),
    (0.55, re.compile(rf"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-D]{_E}")),
    # codes of letters and digits say nothing by themselves
    (0.1, re.compile(rf"[A-Z]{{2}}{_S}?\d\d{_S}?\d\d{_S}?\d\d{_S}?[A-Z]{_E}")),
    (0.1, re.compile(rf"[A-Z]{{1,3}}-?\d{{2,}}[A-Z]{{0,3}}\d{{4,8}}{_E}")),
    (0.1, re.compile(rf"[A-Z]{{1,3}}-\d{{3,6}}-\d{{3,8}}{_E}")),
    (0.1, re.compile(rf"(?=(?:[A-Z]*\d){{5}})[A-Z][A-Z0-9]{{7,10}}{_E}")),
]
_IBAN = re.compile(rf"[A-Z]{{2}}\d\d(?:{_S}?[A-Z0-9]{{4}}){{3,7}}(?:{_S}?[A-Z0-9]{{1,3}})?{_E}")
_CARD = re.compile(rf"\d{{4}}([- ]?)\d{{4}}\1\d{{4}}\1\d{{1,7}}{_E}")
_NUMBER = re.compile(rf"{_B}(?:\+(?=\d)|\((?=0?\d{{1,4}}\))|(?=\d[\d().\-/‑  ]{{4}})|(?=[A-Z]{{1,2}}[-{_S[1:-1]}]?\d\d))")
_WORDS = "|".join(DIGIT_WORDS)
_SPOKEN = re.compile(rf"(?i)(?<![A-Za-z])(?:{_WORDS})(?:[ ,-]+(?:{_WORDS})){{6,14}}(?![A-Za-z])")

_LOCAL = r"(?<![A-Za-z0-9_%+/\-])(?<![A-Za-z0-9]\.)[A-Za-z0-9_][A-Za-z0-9_%+\-]*(?:(?:\.| \. |\[\.\]|\(\.\)| \[?\(?dot\)?\]? )[A-Za-z0-9_%+\-]+)*?"
_DOT = r"(?: ?[\[({]\.[\])}] ?|\.| ?[\[({]dot[\])}] ?| dot )"
_HOST = rf"[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9\-@])"
_EMAIL = re.compile(rf"(?i){_LOCAL}(?: ?[@＠] ?| ?[\[({{] ?at ?[\])}}] ?){_HOST}(?! ?dot )(?!\.[A-Za-z])")
_SAID = re.compile(r"(?i)(?<![A-Za-z0-9_%+.\-])[A-Za-z0-9_](?:[A-Za-z0-9_%+.\-]*[A-Za-z0-9_])? at (?:[A-Za-z0-9\-]+ dot )+[A-Za-z]{2,24}(?![A-Za-z0-9\-])")

_HOUSE = r"\d{1,5}(?:[a-zA-Z]|(?: (?:bis|ter)))?(?:[-–/]\d{1,5}[a-zA-Z]?)?"
# five digits after the street may be the place's code: only without a comma, and less sure than a number before
_HOUSE_AFTER = _HOUSE.replace("1,5", "1,4")
_EN = re.compile(rf"(?<![\w.\-/:]){_HOUSE},? (?:(?:[A-Z][\w'’-]*\.?|\d{{1,3}}(?:st|nd|rd|th)) ){{1,3}}(?:{'|'.join(STREET_EN)})\b|(?<![\w.\-/:])(?i:{_HOUSE},? (?:[^\W\d_]{{4,}} )(?:{'|'.join(x for x in STREET_EN if x not in STREET_PLAIN)})\b)(?=[.,;)]|$| apt| \()")
_ROM = "|".join(STREET_ROMANCE)
_FR = re.compile(rf"(?<![\w.\-/:]){_HOUSE},? (?i:{_ROM}) (?:(?i:de la |de l['’]|de los |des |del |du |do |da |dos |de |d['’]))?[^\W\d_][\w'’-]+")
_SHORT = "|".join(map(re.escape, STREET_SHORT))
_ES = re.compile(rf"(?<!\w)(?i:{_ROM}|{_SHORT}) ?(?:(?i:de la |de los |del |do |da |dos |de ))?(?:[^\W\d_][\w'’-]+)(?: [^\W\d_a-z][\w'’-]+)?,? (?:n[.º°]{{1,2}} ?|д\. ?)?{_HOUSE_AFTER}(?!\w)")
_ES_LONG = re.compile(rf"(?<!\w)(?i:{_ROM}|{_SHORT}) ?(?:(?i:de la |de los |del |do |da |dos |de ))?(?:[^\W\d_][\w'’-]+)(?: [^\W\d_a-z][\w'’-]+)? (?:n[.º°]{{1,2}} ?|д\. ?)?\d{{5}}(?!\w)")
_DE = re.compile(rf"(?<![\w-])[^\W\d_][\w-]{{2,}}(?:{'|'.join(re.escape(x) for x in STREET_GERMANIC)}),? \d{{1,4}}(?: ?[a-z](?!\w))?(?:[-–/]\d{{1,4}} ?[a-z]?)?(?!\w)", re.I)

#: Titles; labels of names; what persons do; what is done to them.
TITLES = "Mr Mrs Ms Miss Dr Prof Mx Sr Sra Frau Herr Herrn Mme Mlle Monsieur Madame Señor Señora Dott Sig Pan Pani Professor Doctor Captain Judge Nurse Senator Господин Госпожа г-н г-жа Κύριος Κυρία".split()
LABELS = "signed|full name|name|contact|contact person|owner|author|holder|attn|patient|client|nombre|nom|nome|имя|фио|ansprechpartner".split("|")
DID = "said|says|wrote|writes|asked|asks|told|called|replied|answered|signed|joined|agreed|thanked|mentioned|explained|lives|works|who|schrieb|sagte|fragte|rief|dijo|escribió|firmó|disse|escreveu|a dit|a écrit".split("|")
TO = "met|met with|ask|asked|tell|told|dear|hi|hello|thank|thanks to|call|called|email|emailed|said|wrote to|spoke with|spoke to|talk to|interviewed|written by|signed by|taken by|shared by|pregunta a|fale com|firmó|bitte".split("|")
_any = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_TITLES = rf"(?:(?:{_any(TITLES)})\.?(?: (?:Dr|Prof|med)\.)*)"
_LABELS = rf"(?i:{_any(LABELS)})"
_DID = rf"(?:{_any(DID)})"
_TO = rf"(?i:{_any(TO)})"
#: Words that follow a given name or stand in a pair without being a family name.
NO_FAMILY = frozenset("""
Project Team Group Method Model Plan Report Review Notes Note Handbook Guide Index Archive System Server Service Station Bridge River Lake
Mount Island Park Square Street Road Lane Avenue Court Drive Place Way Row Hall House Hospital School College University Institute Library
Museum Church Cathedral Airport Harbour Harbor Company Inc Ltd Llc Gmbh Corp Foundation Award Prize Test Act Law Theorem Protocol Framework
Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December
The And Or But For From With Will Can Could Would Should Is Was Has Had Does Did Said Asked Wrote Please Thanks Thank Dear Hello Best Regards
I He She It We They You This That There Then When Where Who What Why How In On At By To Of As If Not No Yes Also After Before City Town Village
Проект Улица Площадь Институт Отчёт План Метод Город Река Музей
""".casefold().split()) | frozenset(x.casefold() for x in (*STREET_EN, *STREET_ROMANCE, *TITLES))
_CAP = r"(?:(?:O|D|Mc|Mac|L)['’]?)?[^\W\d_a-z](?:[^\W\d_]|['’](?=[^\W\d_]))+"
_NAME = rf"(?P<{{0}}>{_CAP}(?:-{_CAP})?)(?: [^\W\d_a-z]\.){{{{0,2}}}}(?: {PARTICLE})? (?P<{{1}}>{_CAP}(?:-{_CAP})?)"
_PAIR = _NAME.format("a", "b")
_END = r"(?!\w|@|[.:/]\w)"
#: Sure contexts: what stands before, or behind.
_LED = re.compile(rf"(?<!\w)(?:{_TITLES} |{_LABELS}[:,] [\"'“„«]?(?:{_TITLES} )?)(?P<n>{_PAIR}){_END}")
_ASKED = re.compile(rf"(?<!\w)(?:{_TO}) (?:{_TITLES} )?(?P<n>{_PAIR}){_END}")
_FOLLOWED = re.compile(rf"(?<![\w.@+-])(?P<n>{_PAIR})(?=,? ?[(<\[|,] ?(?:\+\d|\(?0\d{{1,4}}\)?[ /-]|\(?\d{{3}}[).-] ?\d{{3}}|[\w.+%-]{{2,}} ?[@＠]|mailto:)| {_DID}\b)")

_ANY = re.compile(rf"(?:-[^\W\d_]+)?(?: [^\W\d_a-z]\.)*(?:,? (?i:{PARTICLE}))? ([^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-[^\W\d_]+)?){_END}")
_BEFORE = re.compile(rf"((?<![\w-])(?:(?i:{PARTICLE}) )?([^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-[^\W\d_]+)?)(, | ))$")
_INITIAL = re.compile(rf"(?<![\w.'’-])([^\W\d_a-z]\.(?: ?[^\W\d_a-z]\.)?)(?: {PARTICLE})? ({_CAP}(?:-{_CAP})?){_END}")
_BACK_SIGN = re.compile(r", [^\W\d_a-z]\.")
_BACK = re.compile(rf"(?<![\w-])(?:{PARTICLE} )?({_CAP}(?:-{_CAP})?), [^\W\d_a-z]\.(?:[^\W\d_a-z]\.)?(?!\w)")
_TITLE = re.compile(rf"(?:(?<!\w){_TITLES}|\b{_LABELS}[:,]|\b(?:by|{_TO})) [\"'“„«(]?$")
#: What numbers its parts by letters.
_PART = re.compile(r"(?i)\b(?:section|plan|option|appendix|annex|type|class|figure|fig|table|vitamin|part|chapter|grade|group|block|room|exhibit|schedule|building|hall|gate|step|phase|variant|version|case)\s+$")
_PLACE = re.compile(r"(?i)(?:\b(?:project|the|place|at the|near|city of|street|river|lake|mount|ship|model|saint|san|santa|st\.) |проект |улица |ул\. )$")
_WHERE = re.compile(r"(?i)\b(?:in|at|from|to|near|aus|nach|en|à|в|из) $")
_CYRILLIC = re.compile(r"(?<!\w)[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)? [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:вич|вна|ична|ьич)(?:а|у|ем|ы|е|ой)?(?!\w)|(?<!\w)[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+(?:вич|вна|ична|ьич)(?:а|у|ем|ы|е|ой)? [А-ЯЁ][а-яё]+(?!\w)|(?<![\w.])[А-ЯЁ]\. ?[А-ЯЁ]\. ?[А-ЯЁ][а-яё]{2,}(?!\w)|(?<!\w)[А-ЯЁ][а-яё]{2,} [А-ЯЁ]\. ?[А-ЯЁ]\.")
#: Common Japanese family names.
_FAMILY_JA = "佐藤|鈴木|高橋|田中|伊藤|渡辺|渡邊|山本|中村|小林|加藤|吉田|山田|佐々木|山口|松本|井上|木村|斎藤|斉藤|清水|山崎|阿部|池田|橋本|石川|前田|藤田|後藤|岡田|長谷川|村上|近藤|石井|坂本|遠藤|青木|藤井|西村|福田|太田|三浦|藤原|岡本|松田|中島|中川|原田|小川"
_CYRILLIC_SIGN = re.compile(r"(?:вич|вна|ична|ьич)|[А-ЯЁ]\.")
_JAPANESE_SIGN = re.compile(r"さん|様|氏|先生|君|ちゃん|教授|博士|名前|担当")
_JAPANESE = re.compile(rf"(?:{_FAMILY_JA})[ 　]?(?:[一-鿿々]{{1,3}}?|[ぁ-ゖ]{{2,4}}?|[ァ-ヺー]{{2,5}}?)(?=さん|様|氏|先生|君|ちゃん|教授|博士)|(?:氏名|名前|担当者?)[:：] ?((?:{_FAMILY_JA})[ 　]?[一-鿿々ぁ-ゖァ-ヺー]{{1,4}})|(?:{_FAMILY_JA})(?=さん|様|氏(?!名)|先生)")


@functools.lru_cache(maxsize=2)
def _signs(model: Model):
    """The automaton over given names, listed and learnt, and over the cheap signs of streets and spoken numbers."""
    import ahocorasick

    a = ahocorasick.Automaton()
    put: dict[str, set[str]] = {}
    for g in (*map(str.lower, GIVEN), *model.given):
        put.setdefault(g, set()).add("name")
    for s in STREET_EN:
        for after in (" ", ",", ".", "\n", ";", ")", "?", "!") if len(s) < 4 else ("",):
            put.setdefault(f" {s.lower()}{after}", set()).add("en")
    for s in STREET_ROMANCE:
        put.setdefault(f"{s} ", set()).add("rom")
    for s in STREET_SHORT:
        put.setdefault(s, set()).add("rom")
    for s in STREET_GERMANIC:
        put.setdefault(f"{s} ", set()).add("ger")
        put.setdefault(f"{s}, ", set()).add("ger")
    for x in DIGIT_WORDS:
        for y in DIGIT_WORDS:
            put.setdefault(f"{x} {y}", set()).add("spoken")
    for words, kind, after in ((TITLES, "led", (" ", ".")), (LABELS, "led", (":", ",")), (TO, "asked", (" ",)), (DID, "did", ("",))):
        for w in words:
            for end in after:
                put.setdefault((" " if kind == "did" else "") + w.lower() + end, set()).add(kind)
    for k, kinds in put.items():
        a.add_word(k, (tuple(kinds), len(k)))
    a.make_automaton()
    return a


def _signed(low: str, model: Model) -> tuple[set[str], list[tuple[int, int]]]:
    """The kinds of signs in a text in small letters, and where given names may stand."""
    found: set[str] = set()
    givens: list[tuple[int, int]] = []
    for last, (kinds, n) in _signs(model).iter(low):
        for k in kinds:
            if k == "name":
                givens.append((last + 1 - n, last + 1))
            else:
                found.add(k)
    if "@" in low or "＠" in low:
        found.add("did")
    return found, givens


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _context(kind: str, text: str, start: int, end: int) -> float:
    before = text[max(0, start - 28) : start]
    if AGAINST.search(before) or re.match(r" ?ms\b", text[end : end + 4]):
        return -0.7
    if kind == "phone":
        return 0.1 if FOR_PHONE.search(before) else 0.0
    return 0.45 if FOR_ID.search(before) or AFTER_ID.match(text, end) else 0.0


def _checked(text: str, digits: str) -> float:
    """What the check digits of an identity number add; a number that can't be one loses."""
    if re.fullmatch(r"\d{8}-?[A-Z]", text):
        return 0.6 if dni(digits, text[-1]) else 0.0
    if len(digits) == 11 and text.isascii():
        return 0.5 if cpf(digits) and "." in text or digits[0] != "0" and tax_id(digits) and " " in text else 0.0
    if len(digits) == 15:
        return 0.4 if with_key(digits) else -0.3
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", text) and (text[:3] in ("000", "666") or text[4:6] == "00" or text.endswith("0000")):
        return -0.5
    return 0.0


_DATE = re.compile(r"(?:19|20)\d\d-[01]\d-[0-3]\d(?!\d)")


def _numbers(text: str) -> list[Span]:
    """The likeliest reading of every number; also those that only a name before them can raise to the threshold."""
    out, done = [], 0
    for m in _NUMBER.finditer(text):
        at = m.start()
        if at < done or _DATE.match(text, at):
            continue
        best: Span | None = None
        for kind, forms in (("phone", PHONES), ("id_number", IDS)):
            for base, form in forms:
                if (x := form.match(text, at)) is None:
                    continue
                digits = re.sub(r"\D", "", x[0])
                if kind == "phone" and not 7 <= len(digits) <= 15:
                    continue
                score = base + _context(kind, text, at, x.end()) + (_checked(x[0], digits) if kind == "id_number" else 0)
                if best is None or (score, x.end()) > (best.score, best.end):
                    best = Span(kind, at, x.end(), score)
        if (x := _IBAN.match(text, at)) and mod97(re.sub(r"\s", "", x[0])):
            best = Span("id_number", at, x.end(), 1.0)
        elif (x := _CARD.match(text, at)) and (best is None or x.end() > best.end):
            digits = re.sub(r"\D", "", x[0])
            best = Span("id_number", at, x.end(), (0.6 if luhn(digits) and len(digits) >= 15 else -0.5) + _context("id_number", text, at, x.end()))
        if best is not None:
            out.append(best)
            if best.score >= 0:
                done = best.end
    return out


def _alike(given: str, family: str) -> bool:
    """Both in the same style of letters."""
    if given.isupper() and len(given) > 1:
        return family.isupper()
    if given.islower():
        return family.islower() and len(family) >= 4
    return family[:1].isupper() and not (family.isupper() and len(family) > 3)


def _named(text: str, at: int, end: int, model: Model, out: list[Span]) -> None:
    """A given name stands at ``at``: the family name after it, or before it."""
    if (at and (text[at - 1].isalnum() or text[at - 1] in "_@.+" or text[at - 1] == "-" and text[at - 2 : at - 1].isalnum())) or text[end : end + 1].isalnum() or text[end : end + 1] == "_":
        return
    given = text[at:end]
    led = 0.2 if _TITLE.search(text, max(0, at - 24), at) else 0.0
    m = _ANY.match(text, end)
    if m and _alike(given, m[1]) and (word := m[1].casefold()) not in NO_FAMILY:
        known = model.familiar(m[1])
        if given.islower():
            score = 0.6 if known else 0.2
        else:
            score = 0.75 if known else 0.1 if word in model.common else 0.55
            score -= 0.2 if not known and _PLACE.search(text[max(0, at - 12) : at]) else 0
            # a street or project has the name in front of its kind
            following = re.match(r" ([^\W\d_]+)", text[m.end() : m.end() + 24])
            if following and following[1][:1].isupper() and following[1].casefold() in NO_FAMILY:
                score -= 0.3
        out.append(Span("name", at, m.end(), score + led))
    m = _BEFORE.search(text, max(0, at - 48), at)
    if m and _alike(given, m[2]) and text[end : end + 1] not in ("@", "＠", "+", "_") and not text[end : end + 3].startswith(" @"):
        known, comma = model.familiar(m[2]), m[3] == ", "
        ahead = text[max(0, m.start() - 24) : m.start()]
        score = (0.7 if comma else 0.5) if known else (0.35 if comma and m[2].casefold() not in model.common and m[2].casefold() not in NO_FAMILY else 0.0)
        score += 0.2 if _TITLE.search(ahead) or comma and re.search(r"(?:^|[\n(|\"“„«]|-- )$", ahead) else 0
        score -= 0.2 if not known and (_PLACE.search(ahead[-12:]) or _WHERE.search(ahead[-6:])) else 0
        out.append(Span("name", m.start(), end, score))


def _initialled(text: str, model: Model, out: list[Span]) -> None:
    """Names with initials in place of the given name."""
    for m in _INITIAL.finditer(text):
        word, ahead = m[2].casefold(), text[max(0, m.start() - 24) : m.start()]
        if word in NO_FAMILY or _PART.search(ahead):
            continue
        known = model.familiar(m[2])
        score = 0.7 if known else 0.0 if word in model.common else 0.55 if m[1].count(".") > 1 else 0.3
        out.append(Span("name", m.start(), m.end(), score + (0.2 if _TITLE.search(ahead) else 0)))
    for m in _BACK.finditer(text) if _BACK_SIGN.search(text) else ():
        if model.familiar(m[1]) or _TITLE.search(text[max(0, m.start() - 24) : m.start()]):
            out.append(Span("name", m.start(), m.end(), 0.65))


def _sure(text: str, found: set[str]) -> Iterator[tuple[re.Match, float]]:
    """Pairs of capitalised words that their surroundings show to be names."""
    for kind, form, score in (("led", _LED, 0.75), ("asked", _ASKED, 0.6), ("did", _FOLLOWED, 0.55)):
        for m in form.finditer(text) if kind in found else ():
            if not {m["a"].casefold(), m["b"].casefold()} & NO_FAMILY and (m["a"].isupper() == m["b"].isupper() or len(m["b"]) < 3):
                yield m, score


def spans(text: str, model: Model = PRIOR) -> list[Span]:
    """What ``text`` holds, from left to right, without overlaps: the higher score wins, then the longer span."""
    out: list[Span] = []
    low = _lower(text)
    if "@" in low or "＠" in low or "(at" in low or "[at" in low or "{at" in low:
        out += [Span("email", m.start(), m.end(), 1.0) for m in _EMAIL.finditer(text)]
    if " dot " in low:
        out += [Span("email", m.start(), m.end(), 0.9) for m in _SAID.finditer(text)]
    found, givens = _signed(low, model)
    numbers = _numbers(text)
    if any(n.kind == "phone" for n in numbers):
        found.add("did")
    if "spoken" in found:
        out += [Span("phone", m.start(), m.end(), 0.8) for m in _SPOKEN.finditer(text)]
    for k, forms in (("en", (_EN,)), ("rom", (_FR, _ES)), ("ger", (_DE,))):
        if k in found:
            out += [Span("address", m.start(), m.end(), 0.85) for f in forms for m in f.finditer(text)]
    if "rom" in found:
        out += [Span("address", m.start(), m.end(), 0.75) for m in _ES_LONG.finditer(text)]
    end = 0
    for a, b in givens:
        if a >= end:
            k = len(out)
            _named(text, a, b, model, out)
            end = max([end, *(s.end for s in out[k:] if s.score >= THRESHOLD)])
    if "." in text:
        _initialled(text, model, out)
    for m, score in _sure(text, found):
        if not {m["a"].casefold(), m["b"].casefold()} & model.common:
            out.append(Span("name", m.start("n"), m.end("n"), score))
    if not text.isascii():
        if _CYRILLIC_SIGN.search(text):
            out += [Span("name", m.start(), m.end(), 0.7) for m in _CYRILLIC.finditer(text)]
        if _JAPANESE_SIGN.search(text):
            out += [Span("name", m.start(1) if m[1] else m.start(), m.end(), 0.7) for m in _JAPANESE.finditer(text)]
    if numbers:
        # a number right behind a name is a person's
        ends = sorted(s.end for s in out if s.kind == "name" and s.score >= THRESHOLD)
        for s in numbers:
            if s.kind == "id_number" and s.score < THRESHOLD and ends:
                i = bisect.bisect_right(ends, s.start)
                near = i and re.fullmatch(r"[,:;|(]? ?[,:;|(]? ?", text[ends[i - 1] : s.start])
                s = s._replace(score=s.score + 0.45) if near else s
            out.append(s)
    return settled(out)


def settled(found: list[Span]) -> list[Span]:
    """Those from ``THRESHOLD`` on, left to right; of overlapping ones the higher score, then the longer, then the earlier."""
    kept: list[Span] = []
    starts: list[int] = []
    for s in sorted((s for s in found if s.score >= THRESHOLD), key=lambda s: (-s.score, s.start - s.end, s.start)):
        i = bisect.bisect_left(starts, s.start)
        if (i == 0 or kept[i - 1].end <= s.start) and (i == len(kept) or s.end <= starts[i]):
            starts.insert(i, s.start)
            kept.insert(i, s)
    return kept


def redact(text: str, model: Model = PRIOR) -> str:
    out, at = [], 0
    for s in spans(text, model):
        out += [text[at : s.start], PLACEHOLDER[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


# ---- what the corpus shows ----------------------------------------------------------------------

#: A word among the marks around it; parts of mail addresses, hosts and codes say nothing about writing.
_WORD = re.compile(r"[^\w@＠]*([^\W\d_]{2,})(?:['’]\w+)?[^\w@＠]*")
_RUN = re.compile(rf"(?<![\w@.+/-])({_CAP})(?:-{_CAP})?(?: [^\W\d_a-z]\.)*(?: {PARTICLE})?(?= ({_CAP}))")


def _evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in small letters and capitalised, and of pairs of capitalised words, those in sure contexts apart."""
    pairs: Counter = Counter()
    sure: Counter = Counter()
    low: Counter = Counter()
    high: Counter = Counter()

    def passed() -> pa.RecordBatch:
        rows = [(a, b, n, sure[a, b], 0, 0) for (a, b), n in pairs.items()]
        rows += [(w, None, 0, 0, low[w], high[w]) for w in low.keys() | high.keys()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["a", "b", "n", "sure", "low", "high"])
        for c in (pairs, sure, low, high):
            c.clear()
        return out

    for batch in batches:
        words: Counter = Counter()
        for text in batch.column(0).to_pylist():
            words.update(text.split())
            pairs.update((m[1].casefold(), m[2].casefold()) for m in _RUN.finditer(text))
            for m, _ in _sure(text, _signed(_lower(text), PRIOR)[0]):
                key = m["a"].split("-")[0].casefold(), m["b"].split("-")[0].casefold()
                sure[key] += 1
                pairs[key] += 0
        for token, n in words.items():
            if m := _WORD.fullmatch(token):
                (low if m[1].islower() else high)[m[1].casefold()] += n
        if len(pairs) + len(low) + len(high) > HELD:
            yield passed()
    if pairs or low or high:
        yield passed()


def evidence(df: DataFrame, text: str) -> DataFrame:
    """(a, b, n, sure, low, high): per pair of words how often it stands capitalised and in sure contexts; per word (b null) how often in small letters and capitalised."""
    seen = df.select(df[text].alias("text")).filter("text <> ''").mapInArrow(_evidence, "a string, b string, n bigint, sure bigint, low bigint, high bigint")
    return seen.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sure", "low", "high")])


def learn(df: DataFrame, text: str) -> Model:
    """The model of the whole corpus in column ``text``.

    A word is a given name if it leads at least three different pairs of which two or more stood in sure
    contexts, mostly leads pairs there, and isn't mostly written in small letters; a family name if it
    follows a given name; an ending is one of family names if most of the words with it are. What is
    learnt shows more given names: those that mostly lead pairs with family names, known or by their
    ending. ``ROUNDS`` times over; each part is cut to its greatest size by evidence, so the model doesn't
    grow with the data.
    """
    from ..common import cut

    seen = cut(evidence(df, text))
    words = seen.filter("b is null").select(F.col("a").alias("word"), "low", "high")
    pairs = seen.filter("b is not null").select("a", "b", "n", "sure")
    led = pairs.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("pairs"), F.sum("n").alias("n"), F.count_if(F.col("sure") > 0).alias("kinds"), F.sum("sure").alias("sure"))
    after = pairs.groupBy(F.col("b").alias("word")).agg(F.sum("n").alias("behind"))
    led = cut(led.join(words, "word", "left").join(after, "word", "left").fillna(0))
    likely = led.filter("n >= behind and low <= 2 * n")
    given = cut(likely.filter("kinds >= 2 and pairs >= 3 and sure >= 0.2 * n").select("word", "sure"))
    listed = df.sparkSession.createDataFrame([(g.casefold(),) for g in GIVEN], "word string")
    ends = lambda d: d.select("word", F.explode(F.array(F.right("word", F.lit(3)), F.right("word", F.lit(4)))).alias("end")).filter("length(word) >= 5")
    of_all = cut(ends(words.filter("high > 0")).groupBy("end").agg(F.count("*").alias("words")))
    for _ in range(ROUNDS):
        known = given.select("word").union(listed).distinct()
        follows = pairs.join(known.withColumnRenamed("word", "a"), "a", "left_semi").groupBy(F.col("b").alias("word")).agg(F.sum(F.greatest("n", "sure")).alias("n"))
        family = cut(follows.join(words, "word", "left").join(known, "word", "left_anti").filter("low <= high and length(word) >= 3").select("word", "n"))
        # endings: of the words seen capitalised, how many are family names
        of_names = ends(family).groupBy("end").agg(F.count("*").alias("names"))
        endings = cut(of_names.join(of_all, "end").filter("names >= 5 and names >= 0.5 * words").orderBy(F.col("names").desc(), "end").limit(MOST_ENDINGS))
        alike = ends(pairs.select(F.col("b").alias("word")).distinct()).join(endings, "end", "left_semi").select("word").union(family.select("word")).distinct()
        with_name = pairs.join(alike.withColumnRenamed("word", "b"), "b", "left_semi").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("named"), F.sum("n").alias("of"))
        # what stands before given names is a word like 'yesterday'
        before = pairs.join(known.withColumnRenamed("word", "b"), "b", "left_semi").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("ahead"))
        more = likely.join(with_name, "word").join(before, "word", "left").filter("named >= 2 and of >= 0.5 * n and low <= n and coalesce(ahead, 0) <= 0.2 * n").select("word", F.col("named").alias("sure"))
        given = cut(given.union(more).groupBy("word").agg(F.max("sure").alias("sure")).join(listed, "word", "left_anti").filter("length(word) >= 2").orderBy(F.col("sure").desc(), "word").limit(MOST_GIVEN))
    common = words.filter("low >= 3 and low > high").orderBy(F.col("low").desc(), "word").limit(MOST_COMMON)
    family = family.orderBy(F.col("n").desc(), "word").limit(MOST_FAMILY)
    part = lambda d, c: frozenset(r[0] for r in d.select(c).collect())
    return Model(part(given, "word"), part(family, "word"), part(endings, "end"), part(common, "word"))


def find(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, pii_kind, start_at bigint, length): one row for each occurrence, counted in characters from 1.

    Without a ``model`` the texts themselves are learnt from first. Null and empty texts give nothing;
    repeated rows repeat; texts are read whole however long; other columns are dropped; an empty table
    gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(learn(df, text) if model is None else model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, starts, sizes = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s in spans(t, sent.value) if t else ():
                    rows.append(i)
                    kinds.append(s.kind)
                    starts.append(s.start + 1)
                    sizes.append(s.end - s.start)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["key", "pii_kind", "start_at", "length"])

    return df.select(df[key].alias("key"), df[text].alias("text")).filter("text <> ''").mapInArrow(run, f"key {kind}, pii_kind string, start_at bigint, length bigint").withColumnRenamed("key", key)


def redacted(df: DataFrame, key: str, text: str, model: Model | None = None) -> DataFrame:
    """(key, text): the texts with typed placeholders, all else unchanged; null stays null. ``model`` as for ``find``."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(learn(df, text) if model is None else model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t and redact(t, sent.value) for t in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

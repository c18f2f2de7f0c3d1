"""Template residue and error-page text: records that hold unfilled slots, filler, error pages or notices about scripts.

A text is cut into units (lines and sentences, without markup), and units are aligned with those of all records by their frames: the unit with its
slots and varying words blanked, and the two or three words that it begins or ends with. Three things make a record a case.

*Whole-page templates that recur.* What a site or a form puts in place of a review stands as the whole text of some records and within others, whatever
language their reviewers write. A sentence of reviewers stands among sentences of its own language, a headline-like review stands alone only, and
a copied review is not one unit. So a frame, beginning or end is a template's where it is the whole text of several records, within others at most ten times
as often, and there in no language for the most part. This needs no word list; the language of a record comes from a column that may be null or wrong at times.

*Slots.* Slot syntaxes of template languages are cases by form. Brackets that reviewers use too count where they keep a name that stands in a slot of
other records, or where the unit with its slots blanked is that of other records with slots. Records of one template are aligned by the
texts between its slots; a name, a default or a blank counts at a position that other records fill with values that vary.

*Seeds.* Fixed expressions for common messages, filler and notices in eight languages, for tables where a text doesn't recur. They cover
no language or site beyond what they list. Texts that only look like a page count where they recur as the whole text of several records.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import by_place, materialize, narrow, place

# --- Slots -----------------------------------------------------------------------------------------------------------

_NAME = r"[^\W\d_][\w.]*"
#: Slot syntaxes that no reviewer writes; the groups hold the variable's name.
_STRONG = re.compile(
    rf"\{{\{{\s*({_NAME})\s*\}}\}}|\$\{{\s*({_NAME})\s*\}}|%\(({_NAME})\)[sd]|<%[=-]?\s*({_NAME})\s*-?%>|\{{%-?\s*(?:\w+\s+)?({_NAME})\s*-?%\}}|@@({_NAME})@@|__({_NAME}?[^\W_])__|\[\[\s*({_NAME})\s*\]\]"
    r"|<(\w+)_here>|\{(\d{1,2})\}|#([^\W\d_]\w*)#|%([^\W\d_]\w*)%"
    r"|[\[(<](?:insert|fill in|add|enter|your|hier|insérer|insérez|escriba aquí|inserisci|inserire|vul hier|vul|insira|coloque|вставьте|введите)\s+([^\[\](){}<>\n]+?)(?:\s+(?:here|goes here|einsetzen|einfügen|eintragen|ici|aquí|qui|in|in te vullen|aqui|сюда|здесь))?[\])>]",
    re.IGNORECASE,
)
#: Syntaxes that reviewers use too.
_WEAK = re.compile(r"\[([^\W\d_][\w .]*)\]|\{([^\W\d_][\w.]*)\}|<([^\W\d_]\w*)>")
_TAGS = (
    "a abbr b big blockquote body br button center code dd div dl dt em font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main meta nav noscript ol p pre s "
    "script section small span strong style sub sup table tbody td th thead title tr tt u ul"
).split()
_TAG = re.compile(rf"</?(?:{'|'.join(_TAGS)})(?:\s[^<>]*)?/?>", re.IGNORECASE)
#: Tags of a page as a whole; reviews hold those of single words and lines only.
_PAGE_TAG = re.compile(r"<(?:!doctype|html|head|title|body|h1|h2|hr|iframe|noscript|form|script|meta|center)\b[^<>]*>", re.IGNORECASE)
#: White space and marks around a unit.
_EDGE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "*=~-–—|•·\"'«»"


def _name(m: re.Match) -> str:
    return re.sub(r"[\W_]+", "_", next((g for g in m.groups() if g), "").lower()).strip("_")


# --- Filler ----------------------------------------------------------------------------------------------------------

_FILLER = re.compile(
    r"""\s*(?:
    lorem\s+ipsum\b
    |(?:this\s+is\s+a\s+)?(?:placeholder|dummy|sample|example)\s+(?:text|review|body|content|title|copy)\b(?!\s+(?:says?|said|was|is|in|on)\b)
    |(?:sample|example|dummy|placeholder)\s+text\b
    |(?:your|the|my)\s+(?:review|text|title|content|body|review\s+text|review\s+title|comment)\s+(?:text\s+)?(?:goes|comes|will\s+be|should\s+go)\s+here\b
    |(?:to\s?do|tbd|fixme|xxx)\s*[:\-–]
    |(?:type|write|enter|insert|put|add)\s+(?:your|the|a)\s+(?:review|text|comment|title)\s+(?:text\s+)?here\b
    |test(?:[\s\d,.]+test)+\b
    |(?:-+\s*)?no\s+content\s+yet\b
    |(?:\w+\s+)?(?:asdf|qwert|qwerty|yuiop|hjkl)\b
    |(?:x{2,}[\s.,]+){2,}
    |foo\s+bar\b
    |blind\s?text\b|(?:platzhalter|muster|füll)-?text\b|hier\s+steht\s+(?:später|bald|dann|noch)\b
    |texte\s+(?:à\s+remplacer|d['’]exemple|factice|provisoire)|votre\s+(?:avis|texte)\s+ici
    |testo\s+(?:segnaposto|di\s+(?:prova|esempio))|texto\s+(?:de\s+(?:ejemplo|relleno|prueba|exemplo)|provis)|(?:voorbeeld|tijdelijke)\s*tekst|su\s+texto\s+aquí
    |ダミーテキスト|(?:ここに|サンプル)(?:レビュー|テキスト|本文)|здесь\s+будет\s+текст|текст[\s-]+заполнитель
    )""",
    re.IGNORECASE | re.VERBOSE,
)
#: A unit of one or a few words said over and over.
_REPEATED = re.compile(r"\s*((?:[^\W\d_]{2,12})(?:\s[^\W\d_]{2,12})?)(?:[\s,.;]+\1){2,}(?:[\s,.;]+\1|[\s,.;!]*$)", re.IGNORECASE)

# --- Error pages -----------------------------------------------------------------------------------------------------

_REASON = (
    r"(?:bad\s+gateway|forbidden|gateway\s+time-?\s?out|internal\s+server\s+error|(?:page\s+)?not\s+found|service\s+(?:temporarily\s+)?unavailable|too\s+many\s+requests|unauthori[sz]ed|bad\s+request"
    r"|request\s+time-?\s?out|access\s+denied|method\s+not\s+allowed|payload\s+too\s+large)"
)
#: Where a message ends: at the end of its unit or before a word with a capital, as it may run into a review without a mark between.
_END = r"(?:\s*$|(?=\s+(?-i:[^\W\d_a-zß-öø-ÿ]|[¡¿])))"
_ERROR = re.compile(
    rf"""\s*(?:
    (?:(?:err(?:or)?|http|status|code|http\s+status|error\s+code)\b\s*[:#]?\s*|http/\d(?:\.\d)?\s+)?[45]\d\d\s*[-–—:/|.,)]*\s*{_REASON}\b.*?{_END}
    |(?:error|http|status)?\s*[:\-–]?\s*{_REASON}\s*(?:[.!]|\(?\s*[45]\d\d\)?|[\s\-–—/|:]|ray\b|trace\b|request\s+id\b|incident\b|ref\b|id\b|\(|[0-9a-f]{{6,}}|\))*{_END}
    |(?:error|err|http|status|code)\s*[:#]?\s*[45]\d\d\s*[.!)]*{_END}
    |\{{\s*"?(?:error|status|code|message)"?\s*:\s*.*?\}}{_END}
    |(?:warning|notice|fatal\s+error|parse\s+error|deprecated|strict\s+standards)\s*:.*\bon\s+line\s+\d+
    |(?:exception\s+in\s+thread\b.*|caused\s+by\s*:\s*)?(?:[a-z_$][\w$]*\.)+\w*(?:exception|error)\b\s*:?.*
    |traceback\s+\(most\s+recent\s+call\s+last\)
    |(?:\w+error|\w+exception)\s*:\s.+
    |(?:uncaught|unhandled)\s+\w*(?:error|exception|rejection)\b
    |(?:database|db|sql|mysql|redis|backend|upstream)\s+(?:connection|request|error|query|server)\b.*(?:fail|timeout|timed\s+out|refused|lost|error|reset|unavailable|gone)
    |(?:the\s+|our\s+|this\s+)?(?:server|service|site|system|website)\s+(?:is\s+)?(?:temporarily|currently|momentarily)?\s*(?:unavailable|overloaded|down\s+for\s+maintenance|under\s+maintenance)\b
    |access\s+to\s+this\s+(?:page|site|resource|website|section)\s+(?:was|is|has\s+been)\s+(?:denied|blocked|forbidden|restricted)
    |(?:the|this|that)\s+(?:requested\s+)?(?:page|address|resource|url|document|file|link|item|review|content|site)\b.*\b(?:could\s+not\s+be\s+found|couldn['’]t\s+be\s+found|(?:can(?:not|['’]t)|could\s?n['’]t)\s+be\s+(?:found|displayed|shown|loaded)|was\s+not\s+found|does\s+not\s+exist|doesn['’]t\s+exist|no\s+longer\s+(?:available|exists?)|is\s+not\s+available(?:[.!\s]*{_END}|\s+(?:in\s+your|at\s+this|right\s+now))|failed\s+to\s+load|has\s+been\s+(?:removed|moved))
    |(?:sorry|oops|uh-?oh|whoops|hmm|oh\s+no)\b[,!.\s–-]+(?:we|something|this|that|the|an?)\b.*(?:snag|went\s+wrong|failed|problem|error|not\s+found|broke|unavailable|could\s?n['’]t|cannot|couldn|did(?:\s+not|n['’]t)\s+work)
    |something\s+went\s+wrong\b
    |we\s+(?:hit\s+a\s+snag|are\s+having\s+(?:technical\s+)?(?:problems|difficulties)|could\s?n['’]t\s+(?:load|find)\s+(?:this|that|the)\s+page)
    |(?:we|this\s+(?:site|page|shop)|our\s+(?:site|shop))\s+(?:are|is)\s+(?:currently\s+|temporarily\s+)?(?:down|offline|under|closed)\s+(?:for\s+)?maintenance
    |an?\s+(?:unexpected|internal|unknown)\s+error\s+(?:has\s+)?occurred
    |your\s+(?:session|login)\s+(?:has\s+)?(?:expired|timed\s+out)
    |session\s+(?:has\s+)?expired\b[.!;,]?(?:\s*(?:please\b|log|sign)|{_END})
    |too\s+many\s+requests\s+(?:from|in|for)\b
    |die\s+(?:angeforderte|gesuchte|gewünschte)\s+(?:seite|adresse|datei)\b.*nicht|(?:der|unser)\s+(?:dienst|server)\s+ist\s+(?:vorübergehend|zurzeit|derzeit|momentan)
    |seite\s+nicht\s+(?:erreichbar|gefunden)|zugriff\s+verweigert|zeitüberschreitung\b|interner\s+(?:server)?fehler\b|(?:ihre|deine)\s+sitzung\s+ist\s+abgelaufen|dienst\s+nicht\s+verfügbar
    |page\s+(?:introuvable|non\s+trouvée)|acc[eè]s\s+(?:refusé|interdit)|délai\s+(?:d['’]attente\s+)?dépassé|cette\s+page\s+(?:est\s+)?(?:momentanément|temporairement|n['’]est\s+pas|n['’]existe|est\s+introuvable)|erreur\s+(?:interne|serveur)\b|service\s+(?:momentanément\s+)?indisponible|votre\s+session\s+a\s+expiré
    |p[áa]gina\s+n[oã]o?\s+encontrada|acceso\s+denegado|tiempo\s+de\s+espera\s+agotado|se\s+ha\s+producido\s+un\s+error|(?:el\s+)?servicio\s+no\s+(?:está\s+)?disponible|su\s+sesión\s+ha\s+(?:expirado|caducado)|error\s+interno\b
    |la\s+(?:sua\s+|tua\s+)?sessione\s+è\s+scaduta|pagina\s+non\s+trovata|accesso\s+negato|si\s+è\s+verificato\s+un\s+errore|tempo\s+scaduto|servizio\s+non\s+disponibile|errore\s+interno\b
    |pagina\s+niet\s+gevonden|toegang\s+geweigerd|er\s+is\s+(?:een\s+fout|iets\s+mis)|acesso\s+negado|tempo\s+(?:de\s+espera\s+)?esgotado|ocorreu\s+um\s+erro|serviço\s+indisponível|sessão\s+expirada|a\s+sua\s+sessão
    |страница\s+не\s+найдена|доступ\s+(?:запрещ|закрыт)|сервер\s+(?:временно\s+)?недоступен|время\s+ожидания\s+истекло|внутренняя\s+ошибка|сессия\s+истекла|произошла\s+ошибка
    )""",
    re.IGNORECASE | re.VERBOSE | re.DOTALL,
)
#: The same in a language that doesn't put such words first.
_ERROR_LATER = re.compile(r".*?(?:ページ|サーバー|サービス|アクセス|セッション|エラー).*?(?:見つかりません|利用できません|拒否|切れました|発生しました|エラー)")
_KANA = re.compile("[\u30a0-\u30ff]")
#: What a reviewer says about errors: the unit goes on to talk of a product or of themselves.
_TOLD = re.compile(r"\b(?:i|me|my|mine|we\s+bought|ich|mein\w*|mir|je|j['’]ai|mon|ma|mes|yo|mi|io|mio|mia|ik|mijn|eu|meu|minha|я|мой|мне)\b|(?:produkt|produit|producto|prodotto|product)\b", re.IGNORECASE)

# --- Notices about scripts -------------------------------------------------------------------------------------------

_SCRIPTS = re.compile(r"\b(?:java\s?script|js|(?:client-side\s+)?scripts?|scripting|script\s+execution)\b|JavaScript|スクリプト|скрипт", re.IGNORECASE)
_COOKIES = re.compile(r"\b(?:cookies?|cookie-?einstellungen)\b|クッキー", re.IGNORECASE)
_NEEDED = re.compile(
    r"""\b(?:enable[ds]?|turn(?:ed)?\s+(?:it\s+)?(?:on|off)|switch(?:ed)?\s+(?:it\s+)?(?:on|off)|activate|allow(?:ed)?|accept|unblock|requires?|relies|needs?|necessary|must|cannot\s+work|blocked|blocks|disabled|deactivated|is\s+off|off\s+in|off[,.;]|(?:is|are)\s+required|(?:is|are)\s+not\s+(?:supported|enabled|available|allowed)|without)\b
    |\boff\b|aktivier\w*|schalten?\b|einschalten|erforderlich|benötigt|zulassen|deaktiviert|activ(?:er|ez|e|é|a|ar)\b|nécessite|besoin|requiert|autoris|désactivé|habilit\w+|necesit\w+|requiere|permit\w*|desactivad\w+
    |abilit\w+|attiv\w+|richied\w+|consent\w+|disattivat\w+|\bzet\b|inschakel\w*|\bvereist|\bnodig|\bsta\b.*\btoe\b|ativ[ae]\w*|habilite|necessita|requer|precisa|有効|必要|許可|включите|необходим|требу|разреш""",
    re.IGNORECASE | re.VERBOSE,
)


def _notice(unit: str) -> bool:
    scripts, cookies = _SCRIPTS.search(unit), _COOKIES.search(unit)
    if not (scripts or cookies) or not _NEEDED.search(unit) or _TOLD.search(unit):
        return False
    # Cookies are also baked: alone they need a page, site, shop or browser beside them.
    return bool(scripts) or bool(re.search(r"\b(?:browser|site|page|shop|store|website|seite|webseite|cette|navegador|página|pagina|sitio|sito|settings|reload|continue|view)\b", unit, re.IGNORECASE))


# --- Units -----------------------------------------------------------------------------------------------------------

_CUT = re.compile(r"[\r\n\u2028\u2029]+|(?<=[.!?…])\s+|(?<=[。！？])")
#: A short unit with one of these looks like a page's message; it is a case only where it recurs as records' whole text, and hardly ever within one.
_LOOKS = re.compile(r"\b(?:[45]\d\d|error|err|fehler|erreur|errore|erro|fout|timeout|unavailable|denied|expired|reload|try\s+again|overloaded|request\s+id|server|script\w*|cookies?|placeholder|todo|tbd|untitled|n/a|null|undefined|nan)\b|エラー|ошибк", re.IGNORECASE)
#: Parts of words that a text must hold for a notice, or for _LOOKS, to be worth a search; plain look-ups cost far less.
_NOTICE_PARTS = ("script", "js", "cookie", "スクリプト", "скрипт", "クッキー")
_LOOK_PARTS = (
    "err", "fehler", "fout", "timeout", "unavailable", "denied", "expired", "reload", "try", "overloaded", "request", "server", "script", "cookie", "placeholder", "todo", "tbd", "untitled", "n/a", "null", "undefined", "nan", "エラー", "ошибк",
)
_STATUS = re.compile(r"[45]\d\d")
_CAPITAL = re.compile(r"\s(?=[^\W\d_a-zß-öø-ÿ]|[¡¿])")
#: What a review begins with after a message as short as a name may be: "Forbidden Das ...", not "Forbidden City".
_OPENS = re.compile(
    r"\s+(?:[¡¿]|[^\x00-\u024f]|(?:the|a|an|this|that|these|it|its|i|we|my|our|he|she|they|there|not|very|good|great|nice|der|die|das|ein|eine|dies\w*|ich|wir|es|mein\w*|sehr|le|la|les|l['’]\w+|un|une|ce|cette|c['’]\w+|je|j['’]\w+|nous|mon|ma|très"
    r"|el|los|las|una|est[eao]|mi|muy|il|lo|gli|uno|questo|questa|io|molto|de|het|een|deze|dit|ik|zeer|o|os|as|um|uma|este|esta|eu|meu|minha|muito)\b)",
    re.IGNORECASE,
)
_DIGIT = re.compile(r"\d")
_VARYING = re.compile(r"\b(?=\w*\d)[\w-]+\b")

CERTAIN, ALIGNED, WHOLE, WITHIN, EVIDENCE, FORM, ALONE, AMONG = "certain", "aligned", "whole", "within", "evidence", "form", "alone", "among"

# --- Alignment -------------------------------------------------------------------------------------------------------

#: Values that stand for none; they count only at a position that other records fill.
_DEFAULT = re.compile(
    r"(?<![\w/])(?:n/a|null|none|nil|nan|undefined|unknown|tbd|default|(?:your|the|my)\s+(?:product|item|brand|shop|store|city)(?:\s+name)?\s+here|(?:product|item|brand|shop|store|city|first|last|customer|user)[ _]name"
    r"|valued\s+customer|xxx+|\?{3,})(?![\w/])",
    re.IGNORECASE,
)
#: A gap where a value was left out: a line of underscores, two spaces in a row, a space before a comma or full stop.
_GAP = re.compile(r"(?<![^\W_])_{2,}(?![^\W_])|(?<=\S) {2,}(?=\w)|(?<=\w) +(?=[,.](?:\s|$))")
_WORD = re.compile(r"\w+")
#: What a unit must hold for a slot, and for a default, to be worth a search.
_MARK = re.compile(r"[\[{<$%@#_(]")
_DEFAULT_PARTS = ("n/a", "null", "none", "nil", "nan", "undefined", "unknown", "tbd", "default", " here", "name", "valued", "xxx", "???")
#: Words of an anchor at most, and bits of the filters that keys are looked up in before they leave a task.
_ANCHOR, _BITS = 4, 1 << 23
#: Units and word runs that a task remembers the keys of.
CACHE = 50_000
#: Any bracketed run that may be a slot; the frame of a unit blanks it.
_SLOT = re.compile(
    r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]*\}|%\(\w+\)[sd]|<%[^%\n]*%>|\{%[^%\n]*%\}|@@\w+?@@|__[^\W_](?:\w*[^\W_])?__|\[\[[^\[\]\n]*\]\]|#[^\W\d_]\w*#|%[^\W\d_]\w*%|\[[^\[\]\n]+\]|<[^<>\n/]+>|\{[^{}\n]+\}"
)


def _key(text: str) -> int:
    k = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return k - (1 << 64) if k >> 63 else k


def _plain(unit: str) -> str:
    return " ".join(unit.lower().split())


def _gap_may_be(text: str) -> bool:
    """Whether the text holds what every gap does; far cheaper than the expression."""
    return "  " in text or "__" in text or " ," in text or " ." in text


def _gapped(unit: str) -> str | None:
    """The unit with its gaps shown as values of their own; None where it has none."""
    if not _GAP.search(unit):
        return None
    return re.sub("\x01 (?=[,.])", "\x01", _plain(_GAP.sub(" \x01 ", unit)))


def frame(unit: str, plain: str | None = None) -> str:
    """The unit with its slots and words that hold a digit blanked, in lower case, without marks at its ends. plain: what _plain gives, where it is known."""
    if plain is None or _MARK.search(unit):
        plain = _plain(_SLOT.sub("\0", unit))
    return (_VARYING.sub("9", plain) if _DIGIT.search(plain) else plain).strip(" .!?,;:…。！？")


def sides(framed: str) -> list[str]:
    """The frame, and the two and three words that it begins and ends with where it has more."""
    words = framed.split(" ")
    out = [framed]
    for k in (2, 3):
        if len(words) > k:
            out += [f"^{k} " + " ".join(words[:k]), f"${k} " + " ".join(words[-k:])]
    return out


def templates_in(unit: str) -> set[str]:
    """Templates that the unit may be made from: the unit with its slots, its defaults or its gaps cut out."""
    marked, gaps = _MARK.search(unit), _GAP.search(unit)
    plain = _plain(unit)
    defaults = any(map(plain.__contains__, _DEFAULT_PARTS))
    if not (marked or gaps or defaults):
        return set()
    out, slots = set(), _WEAK.sub("\0", _STRONG.sub("\0", plain)) if marked else plain
    out.add(slots)
    if defaults:
        out |= {_DEFAULT.sub("\0", slots), _DEFAULT.sub("\0", plain)}
    if gaps and (gapped := _gapped(unit)):
        out.add((_WEAK.sub("\0", _STRONG.sub("\0", gapped)) if marked else gapped).replace("\x01", "\0"))
    # Two words at least tell a template from a common turn.
    return {t for t in out if "\0" in t and "\0\0" not in t and sum(len(w) > 1 for w in _WORD.findall(t)) >= 2}


def _anchor(template: str) -> str:
    """The first words of the template's longest text between slots; every unit made from the template holds them."""
    words = max((_WORD.findall(x) for x in template.split("\0")), key=lambda w: sum(map(len, w)))
    return " ".join(words[:_ANCHOR])


def values_of(template: str, form: str) -> list[str] | None:
    """What stands in the template's slots where the form is made from it; each text between them is taken where it first occurs."""
    first, *middle, last = template.split("\0")
    if not form.startswith(first) or not form.endswith(last) or len(form) <= len(first) + len(last):
        return None
    out, at, end = [], len(first), len(form) - len(last)
    for x in middle:
        k = form.find(x, at + 1, end)
        if k < 0:
            return None
        out.append(form[at:k])
        at = k + len(x)
    return [*out, form[at:end]] if at < end else None


def _state(value: str) -> str:
    """What a value is: filled, or a name, gap or default that was left; '' where it tells nothing."""
    if value == "\x01":
        return "gap"
    if _STRONG.fullmatch(value) or len(value) > 3 and _WEAK.fullmatch(value):
        return "name"
    if _DEFAULT.fullmatch(value):
        return "default"
    return "" if "\x01" in value or not re.search(r"\w", value) or re.search(r"[\[\]{}<>]", value) else "filled"


def without_markup(text: str) -> str:
    return _TAG.sub("\n", html.unescape(text.replace("\u200b", "").replace("\ufeff", ""))).replace("\xa0", " ")


def _units(clean: str) -> tuple[list[str], int]:
    """Sentences of a text without markup, and the number of its lines."""
    lines = [x for x in re.split(r"[\r\n\u2028\u2029]+", clean) if x.strip()]
    out = []
    for line in lines:
        out += [u for p in _CUT.split(line) if p and (u := p.strip(_EDGE) or p.strip())]
    return out, len(lines)


def _error(unit: str) -> bool:
    """Whether the unit, or a beginning of it up to a word with a capital, is a message in which no reviewer speaks."""
    m = _ERROR.match(unit) or (None if unit.isascii() or not _KANA.search(unit) else _ERROR_LATER.match(unit))
    if m is None:
        return False
    if m.group().isascii() and len(re.findall("[A-Za-z]+", m.group())) < 2 and unit[m.end() :].strip() and not _OPENS.match(unit, m.end()):
        return False  # one word may be part of a name
    if (told := _TOLD.search(m.group())) is None:
        return True
    cuts = [c.start() for c in _CAPITAL.finditer(unit, 0, told.start() + 1)]
    return bool(cuts) and _ERROR.match(unit[: cuts[-1]]) is not None


def _notice_begins(unit: str) -> bool:
    """Whether the unit, or a beginning of it up to a word with a capital, is a notice: the longest beginning in which no reviewer speaks decides."""
    if _notice(unit):
        return True
    if (told := _TOLD.search(unit)) is None:
        return False
    cuts = [m.start() for m in _CAPITAL.finditer(unit, 0, told.start() + 1)]
    return bool(cuts) and _notice(unit[: cuts[-1]])


def _page_key(text: str) -> str:
    return "p:" + _VARYING.sub("9", _plain(text))


def signals(text: str | None, units: list[str] | None = None, lines: int = 0, clean: str = "") -> list[tuple[str, str, str]]:
    """(strength, kind, key) of what a text's units show; units, lines and clean may be given where they are known. A certain signal makes the text a case by itself; the key of an aligned one is
    looked up among the evidence keys of all records; a key that is whole here has to be so in several records, and hardly ever within a longer one."""
    if text is None or not text.strip():
        return []
    found: set[tuple[str, str, str]] = set()
    if units is None:
        clean = without_markup(text)
        units, lines = _units(clean)
    low = clean.lower()
    status = _STATUS.search(low) is not None
    noticed = any(map(low.__contains__, _NOTICE_PARTS))
    looks = (status or any(map(low.__contains__, _LOOK_PARTS))) and _LOOKS.search(clean) is not None
    any_mark = _MARK.search(clean)
    for u in units:
        marked = any_mark and _MARK.search(u)
        strong = list(_STRONG.finditer(u)) if marked else []
        rest = _STRONG.sub("\0", u) if strong else u
        weak = list(_WEAK.finditer(rest)) if marked else []
        if strong:
            found.add((CERTAIN, "slot", ""))
            for m in strong:
                if n := _name(m):
                    found.add((EVIDENCE, "slot", "n:" + n))
        if strong or weak:
            shape = "s:" + _WEAK.sub("\0", rest).lower()
            if strong:
                found.add((EVIDENCE, "slot", shape))
            for m in weak:
                found.add((ALIGNED, "slot", "n:" + _name(m)))
            if weak and shape.strip("s:\0 .,;!?") != "":
                found.add((ALIGNED, "slot", shape))
        if _FILLER.match(u) or _REPEATED.match(u):
            found.add((CERTAIN, "filler", ""))
            continue
        if _error(u):
            found.add((CERTAIN, "error", ""))
        elif noticed and _notice_begins(u):
            found.add((CERTAIN, "notice", ""))
    # A text is compared as a whole, with all its lines; its short sentences stand within it.
    if (looks or _PAGE_TAG.search(text)) and not any(map(_TOLD.search, units)):
        found.add((WHOLE, "page", _page_key(" ".join(units))))
    for u in units if looks and (lines > 1 or len(units) > 1) else ():
        if _LOOKS.search(u) and not _TOLD.search(u):
            found.add((WITHIN, "page", _page_key(u)))
    return sorted(found)


_MARKS = {"id": pa.int64(), "strength": pa.string(), "kind": pa.string(), "keys": pa.list_(pa.int64()), "context": pa.string(), "shown": pa.string()}


def _batch(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.values(), strict=True)], list(schema))


def _openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that the scan looks up: what, key, template. Sides of texts of one unit ('alone'), and anchors of templates with named slots ('named') or others ('left')."""
    for b in batches:
        rows: list[tuple] = []
        for text in b.column(0).to_pylist():
            if text is None or not text.strip():
                continue
            clean = without_markup(text)
            marked = _MARK.search(clean) or (_gap_may_be(clean) and _GAP.search(clean)) or (any(map((low := clean.lower()).__contains__, _DEFAULT_PARTS)) and _DEFAULT.search(low))
            alone = _CUT.search(clean.strip()) is None
            if not (marked or alone):
                continue
            units, _ = _units(clean)
            if len(units) == 1:
                rows += [(ALONE, _key(x), None) for x in sides(frame(units[0]))]
            for t, how in {t: "named" if _WEAK.search(u) or _STRONG.search(u) else "left" for u in units for t in templates_in(u)}.items() if marked else ():
                rows.append((how, _key(_anchor(t)), t))
        yield _batch(rows, {"what": pa.string(), "key": pa.int64(), "template": pa.string()})


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the anchors of templates and of what they begin with."""
    for b in batches:
        rows: set[tuple[int]] = set()
        for t in b.column(0).to_pylist():
            words = (anchor := _anchor(t)).split(" ")
            rows |= {(_key(anchor),), *((_key("^" + " ".join(words[:n])),) for n in range(1, len(words)))}
        yield _batch(list(rows), {"key": pa.int64()})


def _bitmap(keys: DataFrame) -> bytes:
    """A filter of _BITS bits, whatever the number of keys."""
    place = F.pmod("key", F.lit(_BITS)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray(_BITS >> 3)
    for bucket, bits in rows:
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = bits
    return bytes(out)


def _scan(alone: bytes, anchors: bytes):
    digest, mask = xxhash.xxh64_intdigest, _BITS - 1
    grams: dict[str, int] = {}
    known = grams.get

    def held(bits: bytes, text: str) -> int:
        at = digest(text) & mask
        return bits[at >> 3] >> (at & 7) & 1

    def gram(words: str) -> int:
        """1 where the words are an anchor, 2 where one begins with them, 3 for both."""
        if (f := known(words)) is None:
            if len(grams) > CACHE:
                grams.clear()
            f = grams[words] = held(anchors, words) | 2 * held(anchors, "^" + words)
        return f

    def sides_of(framed: str) -> list[str]:
        """The sides that the filter may hold; a frame that it holds is held by its first two words too."""
        words = framed.split(" ", 3)
        if len(words) <= 2:
            return [framed] if held(alone, framed) else []
        out = []
        if held(alone, two := f"^2 {words[0]} {words[1]}"):
            out.append(two)
            if len(words) > 3 and held(alone, three := f"^3 {words[0]} {words[1]} {words[2]}"):
                out.append(three)
            if held(alone, framed):
                out.append(framed)
        words = framed.rsplit(" ", 3)
        if held(alone, two := f"$2 {words[-2]} {words[-1]}"):
            out.append(two)
            if len(words) > 3 and held(alone, three := f"$3 {words[-3]} {words[-2]} {words[-1]}"):
                out.append(three)
        return out

    def forms_of(form: str) -> list[tuple[str, str]]:
        out = []
        words = _WORD.findall(form)
        for k, g in enumerate(words):
            if not (f := known(g)) and (f == 0 or not (f := gram(g))):
                continue
            n = k
            while f:
                if f & 1:
                    out.append((g, form))
                n += 1
                if not f & 2 or n == len(words):
                    break
                g = f"{g} {words[n]}"
                f = gram(g)
        return out

    units_seen: dict[str, tuple[list[int], list[tuple[int, str]]]] = {}

    def looked_up(unit: str) -> tuple[list[int], list[tuple[int, str]]]:
        """Keys of the unit's sides, and its anchors with its form, as far as the filters hold them."""
        if (out := units_seen.get(unit)) is None:
            if len(units_seen) > CACHE:
                units_seen.clear()
            plain = _plain(unit)
            found = forms_of(plain)
            if _gap_may_be(unit) and (gapped := _gapped(unit)):
                found += forms_of(gapped)
            out = units_seen[unit] = [_key(x) for x in sides_of(frame(unit, plain))], [(_key(g), form) for g, form in found]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text, context in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if text is None or not text.strip():
                    continue
                clean = without_markup(text)
                units, lines = _units(clean)
                rows += [(i, strength, kind, [_key(key)], None, None) for strength, kind, key in signals(text, units, lines, clean)]
                keys, forms = set(), set()
                for u in units:
                    k, f = looked_up(u)
                    keys.update(k)
                    forms.update(f)
                if keys:
                    rows.append((i, ALONE if len(units) == 1 else AMONG, "template", list(keys), context, None))
                rows += [(i, FORM, "slot", [key], None, form) for key, form in forms]
            yield _batch(rows, _MARKS)

    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for i, form, template in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if form == re.sub(r" (?=[,.])", "", " ".join(template.replace("\0", "").split())):
                rows.append((i, _key(template), -1, "closed", 0))
            for k, v in enumerate(values_of(template, form) or ()):
                if state := _state(v):
                    rows.append((i, _key(template), k, state, _key(v)))
        yield _batch(rows, {"id": pa.int64(), "template": pa.int64(), "slot": pa.int32(), "state": pa.string(), "value": pa.int64()})


def _induced(marks: DataFrame, templates: DataFrame, min_records: int) -> DataFrame:
    """id, kind of records that keep a name, gap or default where at least min_records others of the template hold values that vary."""
    forms = marks.where(F.col("strength") == FORM).select("id", "key", F.col("shown").alias("form"))
    aligned = materialize(forms.join(templates, "key").select("id", "form", "template").mapInArrow(_align, "id long, template long, slot int, state string, value long"))
    filled = aligned.where("state = 'filled'").groupBy("template", "slot").agg(F.count_distinct("id").alias("n"), F.count_distinct("value").alias("values"))
    open_slots = filled.where((F.col("n") >= min_records) & (F.col("values") > 1)).select("template", "slot")
    left = aligned.where("state in ('name', 'gap', 'default')").join(open_slots, ["template", "slot"], "left_semi")
    # A gap is none where the sentence is whole without a value.
    closed = aligned.where("state = 'closed'").select("template", F.lit("gap").alias("state")).distinct()
    return left.join(closed, ["template", "state"], "left_anti").select("id", F.lit("slot").alias("kind"))


def _recurring(marks: DataFrame, min_alone: int, min_among: int) -> DataFrame:
    """Keys of frames, beginnings and ends that are a template's: several records' whole text, and within others in no language for the most part."""
    here = marks.where(F.col("strength").isin(ALONE, AMONG))
    by_context = here.groupBy("key", "context").agg(F.count(F.when(F.col("strength") == ALONE, 1)).alias("alone"), F.count(F.when(F.col("strength") == AMONG, 1)).alias("among"))
    by_key = by_context.groupBy("key").agg(F.sum("alone").alias("alone"), F.sum("among").alias("among"), F.max("among").alias("most"))
    return by_key.where((F.col("alone") >= min_alone) & (F.col("among") >= min_among) & (F.col("most") * 10 <= F.col("among") * 7) & (F.col("among") <= F.col("alone") * 10)).select("key")


def find_residue(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None, min_records: int = 3, min_alone: int = 2, min_among: int = 3
) -> DataFrame:
    """id, kinds (of 'slot', 'filler', 'error', 'notice', 'page', 'template'): one row for each record that holds residue.

    Null, empty and blank texts are no cases. Whole texts are read. Rows repeated with one id give one row; a null id is kept as one. min_records:
    how many records must show a name or a template in a form that reviewers use too, fill a slot (templates without a name are
    those that two records leave a gap or default in), or have a page-like text as their whole text.
    language_col: a column with the language of a record, by which recurring templates are told from reviewers' sentences; nulls are a language of their own,
    and names count by their first two letters. min_alone, min_among: how many records must have such a template as their whole text, and within
    it. Without the column only slots, seeds and recurring pages are found. An empty table gives no rows; other columns are ignored.
    """
    named = {"id": id_col, "text": text_col} | ({"context": language_col} if language_col else {})
    context = F.lower(F.substring(F.coalesce("context", F.lit("")), 1, 2)) if language_col else F.lit("")
    texts = narrow(df, **named).select(F.col("id").cast("long"), F.col("text").cast("string"), context.alias("context"))
    opened = materialize(texts.select("text").mapInArrow(_openings, "what string, key long, template string").groupBy("what", "key", "template").agg(F.count(F.lit(1)).alias("n")))
    alone = _bitmap(opened.where((F.col("what") == ALONE) & (F.col("n") >= min_alone)).select("key"))
    # A gap or default without a name beside it is a template's where two records have it.
    templates = opened.where("what <> 'alone'").groupBy("key", "template").agg(F.max(F.col("what") == "named").alias("named"), F.sum("n").alias("n")).where("named or n > 1").select("key", "template")
    anchors = _bitmap(templates.select("template").mapInArrow(_beginnings, "key long"))
    # Only units with a signal leave the scan: a small part of any corpus.
    # A text's keys stay together until they are counted, so that they are written as places in a dictionary.
    scanned = materialize(texts.mapInArrow(_scan(alone, anchors), "id long, strength string, kind string, keys array<bigint>, context string, shown string"))
    marks = scanned.select("id", "strength", "kind", F.explode("keys").alias("key"), "context", "shown")
    certain = marks.where(F.col("strength") == CERTAIN).select("id", "kind")
    shown = marks.where(F.col("strength").isin(EVIDENCE, ALIGNED)).groupBy("key").agg(F.count_distinct("id").alias("n"), F.max(F.col("strength") == EVIDENCE).alias("strong"))
    evidence = shown.where(F.col("strong") & (F.col("n") >= min_records)).select("key")
    aligned = marks.where(F.col("strength") == ALIGNED).join(evidence, "key", "left_semi").select("id", "kind")
    pages = marks.where(F.col("strength").isin(WHOLE, WITHIN)).groupBy("key").agg(F.count(F.when(F.col("strength") == WHOLE, 1)).alias("w"), F.count(F.lit(1)).alias("n"))
    # A sentence that stands more often within reviews than alone may be a reviewer's own there.
    pages = pages.where(F.col("w") >= min_records).select("key", (F.col("w") * 2 >= F.col("n")).alias("alone"))
    whole = marks.where(F.col("strength").isin(WHOLE, WITHIN)).join(pages, "key").where((F.col("strength") == WHOLE) | F.col("alone")).select("id", "kind")
    recurring = marks.where(F.col("strength").isin(ALONE, AMONG)).join(_recurring(marks, min_alone, min_among), "key", "left_semi").select("id", "kind")
    found = certain.unionByName(aligned).unionByName(whole).unionByName(recurring).unionByName(_induced(marks, templates, min_records))
    return found.groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None, min_records: int = 3) -> DataFrame:
    """df's rows, all columns unchanged, without the records that hold residue; rows with a null id stay."""
    found = find_residue(df, id_col, text_col, language_col, min_records).select(F.col("id").alias("__residue_id"))
    return by_place(df).join(found, F.col(f"__c{place(df, id_col)}").cast("long") == F.col("__residue_id"), "left_anti").toDF(*df.columns)

"""Template residue, filler, error pages and script notices in a corpus.

Labelled exemplars (`exemplars.py`) lie in an inverted index, term -> exemplars.
Every sentence of a text is a passage window: the exemplars that share a
telling term with it are retrieved, and the TF-IDF mass of the window that one
exemplar contains is its coverage. Document frequencies come from the whole
corpus. Terms are typed first, in two views:

* as words: an unfilled slot of any notation, a word for scripts or for a page,
  a run of made-up Latin or of keyboard rows and stand-in words are one term each;
* as concepts, for the messages of pages, which say the same few things in any
  words and languages: page, not, found, server, session, expired, enable, ...
  Words of no meaning of their own are left out.

A text is residue if a window with a slot lies by exemplars of slots; if a
paragraph is covered by filler or announcements; or if all of it but navigation
is covered by messages, each by one exemplar or by several of them together.
Exemplars with the label `talk` are texts about such things; a window nearer to
one of them is content.

The telling terms of an exemplar are its heaviest ones: the others together
make less than the share that a window must have of it. So a window without any
is covered by none, and a text without any is not looked at further. That loses
nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.llm.exemplars import EXEMPLARS

#: Share of a window's mass that one exemplar must contain, and of the exemplar's that the window must.
COVERED, MATCHED = 0.72, 0.5
#: Terms of a window that may be any part of an exemplar, if a telling one is among them.
PART = 4
#: The same for messages, of which the whole text must consist anyway.
MESSAGE_COVERED = 0.6
#: Share of a window that several messages together, or several lines of stock Latin together, must contain.
MIXED, MIXED_LATIN = 0.75, 0.85
#: Weight of a term that no exemplar has, as a share of that of a term no document has: in words, and in concepts.
UNKNOWN, UNKNOWN_CONCEPT = 0.7, 0.5
#: Least weight of a concept, as the same share; the largest is that of an unknown one.
LEAST = 0.25
#: Share of a paragraph's windows (by words) that must be filler.
PARAGRAPH = 0.8
#: Share of a text's words that may lie outside of messages and navigation.
REST = 0.12
#: Share of a window that messages contain, from which only its other words lie outside of them.
PARTLY = 0.4
#: Words of a run of made-up Latin or of stand-in words.
RUN = 5

#: Notations of a slot that waits to be filled in (fixed values).
SLOTS = [
    r"\{\{[#/^>&!~\s-]*[\w.$@][\w.\- |'\"(),:=@$/~]*\}\}",
    r"\{%-?\s*[\w.\- '\"()|,=!<>]+%\}",
    r"<%=?\s*[\w.\- ]+%>",
    r"[$#]\{[\w.\- ]+\}",
    r"\[\[[\w.\- ]+\]\]",
    r"<<[\w.\- ]+>>",
    r"@@[\w.\- ]+@@",
    r"(?<!\w)__[A-Z]+(?:_[A-Z]+)*__(?!\w)",
    r"(?<![\w$])\$[A-Z]+(?:_[A-Z]+)*\$(?!\w)",
    r"(?<![\w%])%[A-Z]+(?:_[A-Z]+)*%(?!\w)",
    r"(?<![\w}])\{\d{1,2}\}(?!\w)",
    r"(?i:\[(?:your|insert|enter|add|fill in|replace with|type|name of|hier|bitte|ihr|ihre|insérer|insérez|votre|à compléter|inserte|insertar|su|tu|escriba|indique|complete)\b[^\]\n]*\])(?!\()",
    r"(?i:\[(?:your|insert|enter|add|fill in|replace with|type|name of)\b[^\]\n]*\])\((?:\.\.\.|…|#|(?i:url|link|your[-_ ][\w-]+))?\)",
    r"\[(?:[A-Z]\w+ )*(?:Name|Title|Date|Time|Address|City|Location|Number|Email|Company|Phone|Author|Owner|Version|Description)\](?![(\[:])",
    r"<(?:[A-Z]\w+ )+(?:Name|Title|Date|Address|Number|Email|Company|Phone|Author|Owner|Version|Description)>",
    r"<[A-Z]{2,}(?:[ _-][A-Z]{2,})+>",
    r"(?i:<(?:your|insert|enter|ihr|ihre|votre|su|tu)[-_ ][\w\- ]+>)",
    r"(?<!\w)(?i:TBD|TODO|TBA)\s*\([^)\n]+\)",
    r"[【［〔\[][^】］〕\]\n]*(?:待补充|待填写|请输入|请填写|在此填写|此处填写|填写|ここに|入力してください|を入力|を記入|記入してください|未定)[^】］〕\]\n]*[】］〕\]]",
]
SLOT = re.compile("|".join(SLOTS))
#: What is a slot only where its window is like an exemplar: the name of a field in single braces, a bare mark of what is to come.
OPEN_SLOT = re.compile(r"(?<![\w$}{%#@])\{[a-z]\w+\}(?![\w}])|(?<!\w)(?:TBD|TBA|TODO|FIXME)(?!\w)")

#: Syllables of made-up Latin and what a word of it ends in (fixed values).
_SYLLABLES = "a bus ca cam car cas ci cra de di dis do dolor dor e ela el est fen gra i ip ira it la lo lor mi mo mor na ni nim nos o os per pli po pos qui quo ra ran re rem sed si su sum sur ta tat te ti tir tra u ul um ut ve vel ven ver vi"
_LATIN = re.compile(r"(?:" + "|".join(sorted(_SYLLABLES.split(), key=len, reverse=True)) + r")+[strmn]?$")
#: What words of messages mean, by how they begin or are spelled, folded and lower-cased (fixed values).
CONCEPTS = {
    "page": r"dokument\w*|documento|enlaces?|portal|pagin\w*|webseite|sitio|voce|pages?|sites?|websites?|webpages?|apps?|applications?|viewer|dashboard|views?|resources?|documents?|urls?|address|locations?|links?|seiten?|webseiten?|anwendung|adresse|liens?|ressources?|paginas?|sitios?|recursos?|direccion|aplicacion|enderecos?|indirizzo|sito|risorsa|pagina|stron\w*|adres|страниц\w*|саит\w*|сайт\w*|адрес\w*|content|services?|dienst|servicio|servico|servizio|сервис\w*|system|accounts?|file|files",
    "script": r"javascript|js|scripts?|scripting|skripte?n?|скрипт\w*|cookies?",
    "browser": r"browsers?|navigateur|navegador|przegladark\w*|браузер\w*|blocker|settings?",
    "enable": r"opci\w*|einschalten|anschalten|accept\w*|zulassen|erlauben|accetta\w*|aceit\w*|acepta\w*|разреш\w*|enabled?|enabling|activat\w*|allow\w*|turn(?:ed)?|switch(?:ed)?|on|needs?|needed|necessary|requir\w*|must|have to|support\w*|aktivier\w*|einschalten|eingeschaltet\w*|schalten|benotigt|unterstutzt|activez|activer|active|activa\w*|active|exige|necessite\w*|necesit\w*|necess\w*|requier\w*|habilit\w*|permit\w*|debe|abilit\w*|attiv[aio]\w*|ativ[aeo]\w*|requer|precisa|wlacz\w*|wymaga|schakel|vereist|включ\w*|требу\w*|необходим\w*|functionality|autoris\w*|laisse\w*",
    "disabled": r"disabled?|off|blocked|blocks?|deactivat\w*|deaktiviert|abgeschaltet|ausgeschaltet|desactiv\w*|disattiv\w*|desativ\w*|uitgeschakeld|wylaczon\w*|отключ\w*",
    "not": r"nessun\w*|nenhum\w*|aucun\w*|ningun\w*|rien|nada|nicht|unable|not|no|cannot|can|could|couldn|doesn|don|didn|isn|won|aren|without|nothing|wrong|invalid|nicht|kein\w*|ohne|pas|ne|plus|sans|sin|senza|sem|non|nao|nie|niet|geen|brak|не|нет|без|never|longer|any|more",
    "found": r"konnte|konnten|pudo|peut|pu|possible|moglich|posible|possibile|possivel|nalez\w*|возможно|found|find|exists?|existing|available|lost|missing|gefunden|existiert|erreichbar|verfugbar|gibt|trouv\w*|introuvable|existe\w*|disponib\w*|encontr\w*|hallad\w*|trovat\w*|esiste|znalezion\w*|istnieje|gevonden|bestaat|beschikbaar|наиден\w*|найден\w*|существу\w*|доступ(?:на|ен|но)|reach\w*|load\w*|shown?|display\w*|open\w*|cargar|charg\w*|afficher|anzeigen|ver|view",
    "error": r"broke|broken|inattendu\w*|imprevist\w*|unerwartet\w*|inesperad\w*|temporariamente|temporalmente|temporairement|temporaneamente|chwilowo|временно|недоступ\w*|produite?|passiert|schiefgelaufen|aconteceu|mis|malfunction|overload|outage|hata|fatal|errors?|exceptions?|problems?|issues?|trouble|fail\w*|crash\w*|fehler\w*|interner?|erreurs?|errore|erro|blad|fout|ошибк\w*|unavailable|internal|interno|interne|unexpected|occurred|encounter\w*|happened|opgetreden|aufgetreten|survenue|produjo|ocurrido|ocorreu|verificato|wystapil|произошла|err|bad|status|code|codigo|codice|busy|down|overloaded|maintenance|incident|something|went|goes|unable|temporar\w*|vorubergehend|momentan\w*|indisponib\w*|inesperado",
    "access": r"gesperrt|bloqueado|bloque|bloccato|blokada|zablokowan\w*|заблокирован\w*|restreint|limitado|access\w*|permissions?|authori[sz]ed?|unauthori[sz]ed|forbidden|denied|restricted|zugriff|zugang|verweigert|berechtigung|rechte|befugnis|acces|refuse|interdit|autorisation|droits?|acceso|denegad\w*|prohibido|permiso|accesso|negat[oa]|acesso|negado|toegang|geweigerd|dostepu|доступа?|запрещен\w*|rights?|allowed",
    "session": r"einloggen|angemeldet|identifi\w*|credentials?|password|passwort|contrasena|contrasenha|account|conta|konto|compte|cuenta|sessions?|login|logged|log|sign|signed|tokens?|sitzung|anmeld\w*|melden|connect\w*|verbindung|conexion|connexion|connessione|sesion|sessao|sessione|sessie|sesja|zaloguj|сесси\w*|воидите|войдите|inicie|iniciar|effettua",
    "expired": r"valid\w*|gultig\w*|ungultig\w*|valide|valido|valida|wazny|действител\w*|ended|over|closed|expired?|expires|timeouts?|timed?|out|inactiv\w*|idle|abgelaufen|zeituberschreitung|expir\w*|depasse|delai|caduc\w*|tardo|scadut[oa]|verlopen|wygasla|истекла|reset|refused|closed|interrupted|long",
    "server": r"antwort\w*|respuesta|reponse|risposta|resposta|odpowied\w*|ответ\w*|отвеча\w*|attempts?|versuche|tentatives?|intentos|traffic|load|hosting|cdn|connection|netzwerk|network|reseau|rete|rede|сеть|servers?|host|gateway|proxy|upstream|apache|nginx|cloudflare|port|serveur|servidor|serwer|сервер\w*|databases?|backend|requests?|requested|anfrage|angefordert\w*|angefragt\w*|demande\w*|solicitud|solicitad\w*|richiest\w*|opgevraagde|zapytanie|запрашива\w*|response|respond\w*|answer\w*|returned|received|sent|incomplete|api|rate|limits?|exceeded|too|many",
    "sorry": r"sorry|oops|whoops|unfortunately|apologi[sz]e|desole|lamentamos|sentimos|leider|entschuldigung|spiacenti|desculp\w*|helaas|przepraszamy|извините|please|bitte|kindly|por|favor|prego|alstublieft|prosze|пожалуиста|пожалуйста|merci|thanks?|thank",
    "retry": r"повтор\w*|попытк\w*|reintent\w*|recharg\w*|actualis\w*|actualiz\w*|aggiorn\w*|recarreg\w*|ricaric\w*|обнов\w*|neu|laden|odswiez\w*|ververs\w*|minuten|minutos|instantes|augenblick|try|again|retry|later|reload\w*|refresh\w*|back|return|check|checks|erneut|spater|nochmal|wieder|reessay\w*|ressayer|tard|nouveau|intent\w*|nuevo|tarde|mas|riprova|tardi|tente|novamente|opnieuw|probeer|later|sprobuj|ponownie|pozniei|pozniej|попробуите|попробуйте|позже|снова|minut\w*|seconds?|moments?|shortly|soon|wait|continue|proceed\w*|once|administrator|contact|support",
    "ask": r"looking|look|seek\w*|searching|search|want\w*|recherch\w*|cherch\w*|busca\w*|gesucht\w*|sucht|cercat\w*|cerchi|procur\w*|zoekt|szukasz|ищете|visit\w*|using|use|utiliser|usar|usare|korzystac|mistyped|typed|entered",
    "removed": r"removed?|moved?|deleted?|changed?|renamed|entfernt|geloscht|verschoben|supprime\w*|deplace\w*|eliminad\w*|borrad\w*|cambiado|rimoss[oa]|spostat\w*|removid\w*|verwijderd|verplaatst|usunieta|przeniesiona|удален\w*|перемещен\w*",
    "gone": r"gone",
    "check": r"checking|verif\w*|secur\w*|humans?|robots?|bots?|captcha|firewall|ddos|attacks?|protect\w*|protection|automat\w*|redirect\w*|gepruft|prufung|ueberpruft|uberpruft|verification|comprob\w*|verific\w*|controllo|sprawdzan\w*|проверк\w*|instant|moment|loading|process\w*|blocking",
}
#: Words without a meaning of their own in messages (fixed values).
STOP = frozenset(
    "a an the this that these those it its is are was were be been being to of in at by for from with and or if you your yours we our us i my me he she they their there here then than as so but do does did have has had having will would may might should "
    "s t re ve ll d m http https web www like due just new one way our own some only also very still currently now which who what when where how up down into over before after because while some all any each other "
    "konnen bitte dann gerade puis alors entonces ahora poi ora agora entao potem teraz затем сейчас der die das den dem des ein eine einer eines einem einen und oder ist sind war wird werden wurde zu zum zur im in am an auf von vom mit fur um sie ihr ihre ihren ihrem ihnen wir uns es dass wenn diese dieser dieses nur so kann konnen haben hat sein noch nach bei als aus "
    "le la les l un une du de des et ou est sont a au aux en dans sur pour par vous votre vos nous ce cet cette ces que qui il elle se n qu d y été ete peut etre soit "
    "el los las lo unos unas al del y o es son esta este esto estas se su sus que en con para por le ha han hemos ser puede si te tu no "
    "il gli i dello della delle dei degli un uno e ed o per con su da di questa questo che si la le lo e stato stata puo suo sua ha nel nella "
    "o os as um uma e ou do da dos das no na nos nas em para com que esse essa este esta foi ser pode seu sua "
    "het een en of is zijn van voor op met te om u uw deze dit dat die er wordt werd kan "
    "i w z na do sie jest sa ta ten to tej by zostala mozliwe ze dla o "
    "и в на с по для от до вы ваш ваша это эта этот она он была был возможно или что к у мы вам нужно работы".split()
)
_CONCEPT = [(f"\x01{name}", re.compile(pattern)) for name, pattern in CONCEPTS.items()]
#: The same for Chinese and Japanese, as parts of a run of characters (fixed values).
_CJK_CONCEPTS = {
    "page": "页面|网页|网站|本站|本网站|站点|链接|地址|应用|ページ|サイト|アプリ|アドレス|内容|コンテンツ|データ|服务|サービス|系统|システム|資源|资源", "script": "脚本|スクリプト", "browser": "浏览器|ブラウザー?", "enable": "启用|开启|打开|オン|つけて|允许|打开|需要|必要|支持|有効|許可|対応",
    "disabled": "禁用|未启用|关闭|無効|停用", "found": "不存在|找不到|未找到|无法找到|见つか|見つかりません|存在しません|存在|見つから|無法|无法|显示|表示|加载|閲覧|浏览|查看|接続|连接",
    "error": "错误|出错|集中|障害|不具合|异常|失败|问题|内部|エラー|発生|故障|代码|编号|繁忙|混み合|暂时|不可用|維護|维护|メンテナンス", "access": "访问|权限|拒绝|アクセス|権限|拒否|禁止", "session": "会话|登录|セッション|ログイン|登錄|验证码|令牌",
    "expired": "过期|超时|失效|期限|切れ|タイムアウト", "server": "服务器|请求|サーバー?|リクエスト|網關|网关|响应|要求", "sorry": "抱歉|对不起|申し訳|すみません|请|請", "retry": "重试|再试|お待ち|待って|等待|刷新|稍后|重新|片刻|再度|しばらく|試し|時間をおいて|再読み込み|后", "ask": "您要|要找|お探し|探し|検索|搜索|继续",
    "removed": "删除|移除|移动|削除|移動|変更", "check": "检查|验证|確認|安全|人机|检测|正在|稍候", "not": "没有|ません|未",
}
_CJK_CONCEPT = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in _CJK_CONCEPTS.items()))
#: Characters of Chinese without a meaning of their own in messages; those of Japanese are the hiragana.
_CJK_STOP = re.compile(r"[぀-ゟー的了您我们你请在要或已被为该此本是将并且与和於于可能性后设置設定场合場合用版]+")


#: Closed code fences; one that is never closed hides nothing.
_FENCE = re.compile(r"(```|~~~).*?\1", re.S)
_INLINE = re.compile(r"`[^`\n]+`")
_TAG = re.compile(r"(?<!<)</?[A-Za-z][^<>\n]*>")
_HTML = re.compile(r"(?<!<)<(?:!doctype\s+html|html|head|body|title|h[1-6]|noscript)\b[^<>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_CODE = re.compile(
    r"[;{]\s*$|=>|&&|^\s*(?:const|let|var|return|import|export|from \S+ import|def |class |func |package |public |private |async |await |if \(|if !|for \(|for _|while \(|\$ |npm |git |set -|echo |cd |sudo |[})\]]+[,;]?$)"
    r"|\w\(\w*\) \{|:= |%[dsv]\b.*%[dsv]\b|^\s*\"[\w\- ]+\":"
)
_MARKUP = re.compile(r"^[\s>#*|/\-•]+|\*\*|__(?=[a-z])|(?<=[a-z])__")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[^\W\d_A-Z]{2}[.!?])(?=[^\W\d_a-z][^\W\d_A-Z])|(?<=[。！？])|(?<=\.\.\.)\s*")
_WORD = re.compile(r"[^\W_]+|\x00(?:slot|open|latin|standin)")
_TYPED = ("\x00slot", "\x00open")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]+")
_NAME = re.compile(r"[A-Za-z]?[a-z]+(?:[A-Z][a-z0-9]+)+")
_ID = re.compile(r"(?=.*\d)[0-9a-f]{6,}$")
_SCRIPT = {"javascript", "js", "script", "scripts", "scripting"}
_PAGE = {"page", "site", "app", "application", "viewer", "dashboard", "website", "content", "resource"}
_OPEN = re.compile(r"active content", re.I)
#: Paths and addresses inside a message name what it is about, like numbers and ids.
_PATH = re.compile(r"(?<![\w<])/[\w./-]+|\b\w+/\d[\d.]*|\b(?:https?://|www\.)\S+|\b(?:[A-Za-z\d-]+\.)+[a-z]{2,}\b(?!\()")
#: A line of a stack trace.
_FRAME = re.compile(r"^at \S+ \(?\S+:\d+(?::\d+)?\)?$|^File \"[^\"]+\", line \d+", re.I)
_FIRST = re.compile(r"[^\W\d_]+")
_FRAMES = re.compile(r"^\s*(?:at \S+ \(?\S+:\d|File \")", re.I | re.M)
_BAR = re.compile(r"\s*[|·•]\s*")


#: Where a slot may be; a text without any has none.
_TRIGGER = re.compile(r"[{\[<［【〔｛＜]|@@|__|[$%＄％][A-Z]|TB[DA]|TODO|FIXME|(?i:TBD|TODO|TBA)\s*\(")
#: Rows of a keyboard and words that stand in for others (fixed values).
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertz", "azerty")
_STAND_IN = frozenset("foo bar baz qux quux bla blah blub test testing tester tests xyz xxx abc dummy asd hjkl".split())


def _fold(text: str) -> str:
    """Latin letters without accents, format characters gone."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def _type(w: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The terms of a word as words and as concepts. Numbers, ids and names of code have no weight."""
    if w[0] == "\x00":
        return (w,), ()
    plain: list[str] = []
    ideas: list[str] = []
    if not w.isascii() and _CJK.search(w):
        for run in _CJK.findall(w):
            plain += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
            left, last = [], 0
            for m in _CJK_CONCEPT.finditer(run):
                ideas.append("\x01" + m.lastgroup)
                left.append(run[last : m.start()])
                last = m.end()
            left.append(run[last:])
            for piece in left:
                for x in _CJK_STOP.split(piece):
                    ideas += [x[i : i + 2] for i in range(0, len(x), 2)]
        w = _CJK.sub("", w)
        if not w:
            return tuple(plain), tuple(ideas)
    low = _fold(w).lower()
    if low in _SCRIPT:
        plain.append("\x00script")
    elif low in _PAGE:
        plain.append("\x00page")
    elif low.isdigit() or _ID.match(low) or not low:
        return tuple(plain), tuple(ideas)
    elif len(low) > 7 and low.endswith(("error", "exception")):
        plain.append("\x00exception")
    elif _NAME.fullmatch(w) and low not in _SCRIPT:
        return tuple(plain), tuple(ideas)
    else:
        plain.append(low)
    if low.endswith(("error", "exception")):
        ideas.append("\x01error")
    elif (idea := next((name for name, p in _CONCEPT if p.fullmatch(low)), None)) is not None:
        ideas.append(idea)
    elif low not in STOP and len(low) > 1:
        ideas.append(low)
    return tuple(plain), tuple(ideas)


_KNOWN: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}


def typed(words: list[str]) -> tuple[list[str], list[str]]:
    """The terms of words, as words and as concepts."""
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    plain: list[str] = []
    ideas: list[str] = []
    for w in words:
        both = _KNOWN.get(w)
        if both is None:
            both = _KNOWN[w] = _type(w)
        plain += both[0]
        ideas += both[1]
    return plain, ideas


def _words(window: str) -> list[str]:
    if "content" in window or "CONTENT" in window:
        window = _OPEN.sub("JavaScript", window)
    if "/" in window or "." in window[:-1]:
        window = _PATH.sub(" ", window)
    return _WORD.findall(window)


def terms(window: str) -> list[str]:
    """The terms of a window as words."""
    return typed(_words(window))[0]


def concepts(window: str) -> list[str]:
    """The terms of a window as concepts."""
    return typed(_words(window))[1]


def typed_slots(line: str) -> str:
    """A line with its slots replaced by their types."""
    if not _TRIGGER.search(line):
        return line
    return OPEN_SLOT.sub(" \x00open ", SLOT.sub(" \x00slot ", line))


def _stand_in(w: str) -> bool:
    w = w.rstrip("0123456789")
    return w in _STAND_IN or len(w) > 1 and len(set(w)) == 1 or len(w) > 2 and any(w in row for row in _ROWS)


def typed_runs(line: str) -> str:
    """A line that is nothing but made-up Latin, or stand-in words over and over, as the type of that. Its first word must be one already."""
    first = _FIRST.search(line)
    if first is None or not _LATIN.match(low := first[0].lower()) and not _stand_in(low):
        return line
    ws = [w.lower() for w in re.findall(r"[^\W_]+", line)]
    letters = [w for w in ws if not w.isdigit()]
    if len(ws) < RUN or not letters:
        return line
    if 3 * len(letters) >= len(ws) and all(map(_stand_in, letters)):
        return " \x00standin "
    others = 0
    for w in letters:
        if not _LATIN.match(w):
            others += 1
            if w in STOP or others > 0.1 * len(letters):
                return line
    return " \x00latin " if any(len(w) >= 6 for w in letters) else line


MESSAGES = ("error", "notice")
#: Concepts of which a message may consist alone.
STRONG = frozenset(["\x01error", "\x01gone", "\x01access", "\x01expired", "\x01script", "\x01check"])
#: Words of which two or more with a slot tell that it is spoken of (fixed values).
TALK = frozenset("placeholder placeholders template templates slot slots variable variables replaced substituted rendered filled expands expanded interpolated syntax expression parser escaped literal".split())


def _exemplars() -> Iterator[tuple[str, frozenset]]:
    """(label, terms) of every exemplar that has terms: concepts of messages, words of all others."""
    yield "filler", frozenset(["\x00latin"])
    yield "filler", frozenset(["\x00standin"])
    for label, lines in EXEMPLARS.items():
        for line in lines.strip().split("\n"):
            ts = frozenset(concepts(line) if label in MESSAGES else terms(typed_slots(line) if label == "slot" else line))
            if ts:
                yield label, ts


class Index:
    """The inverted index of the exemplars, with weights from the corpus' document frequencies."""

    def __init__(self, documents: int, frequency: dict[str, int]):
        self.labels, self.exemplars = [], []
        for label, ts in dict.fromkeys(_exemplars()):
            self.labels.append("filler" if label == "latin" else label)
            self.exemplars.append(ts)
        rare = math.log(2 + documents)
        self.unknown, self.unknown_concept = UNKNOWN * rare, UNKNOWN_CONCEPT * rare
        vocabulary = {t for e in self.exemplars for t in e}
        self.idf = {t: math.log(1 + (1 + documents) / (1 + frequency.get(t, 0))) for t in vocabulary}
        self.messages = {t for label, e in zip(self.labels, self.exemplars) if label in MESSAGES for t in e}
        for t in self.messages:
            self.idf[t] = min(max(self.idf[t], LEAST * rare), self.unknown_concept)
        self.mass = [sum(self.idf[t] for t in e) for e in self.exemplars]
        self.postings: dict[str, list[int]] = {}
        self.told: dict[str, list[int]] = {}
        for i, e in enumerate(self.exemplars):
            if self.labels[i] in MESSAGES:
                for t in e:
                    self.told.setdefault(t, []).append(i)
            else:
                for t in self._telling(i):
                    self.postings.setdefault(t, []).append(i)
        self.latin = {t for line in EXEMPLARS["latin"].strip().split("\n") for t in terms(line)}
        #: Words without which no window has a slot, or is filler or an announcement.
        self.anchors = frozenset(t for t, es in self.postings.items() if any(self.labels[e] not in ("talk", "navigation") for e in es))

        #: Words of a text outside the messages' vocabulary for one inside, at most, if the text is one: in windows that are
        #: messages by their share of the mass, and in headings, of which there are no more words than of messages.
        in_windows = 1 / MESSAGE_COVERED - 1
        self.most_other = in_windows + 1 + in_windows
        self.seen: dict[str, tuple[bool, int, int, int]] = {}

    def _telling(self, i: int) -> list[str]:
        """The heaviest terms of an exemplar; what is left weighs less than the share of it that a window must have."""
        left, out = self.mass[i], []
        for t in sorted(self.exemplars[i], key=lambda t: (-self.idf[t], t)):
            if left < MATCHED * self.mass[i]:
                break
            out.append(t)
            left -= self.idf[t]
        return out

    def coverage(self, ts: list[str]) -> tuple[str | None, float]:
        """The label of the exemplar that contains most of a window of words, and how much; None where that is too little."""
        distinct = set(ts)
        near = {e for t in distinct if t in self.postings for e in self.postings[t]}
        if not near:
            return None, 0.0
        known = [t for t in distinct if t in self.idf]
        total = sum(self.idf[t] for t in known) + self.unknown * (len(distinct) - len(known))
        best, label = 0.0, None
        for e in near:
            if self.labels[e] == "slot" and not distinct.intersection(_TYPED):
                continue
            s = sum(self.idf[t] for t in self.exemplars[e] & distinct)
            part = len(known) >= PART and s >= 0.95 * total  # a piece of a long exemplar
            if (part or s >= MATCHED * self.mass[e]) and s / total > best:
                best, label = s / total, self.labels[e]
        if best >= COVERED:
            return label, best
        # stock Latin mixes its words freely
        latin = [t for t in known if t in self.latin]
        mixed = sum(self.idf[t] for t in latin) / total
        return ("filler", mixed) if len(latin) >= PART and mixed >= MIXED_LATIN else (None, best)

    def survey(self, words: list[str]) -> tuple[bool, bool, int, int]:
        """Of a whole text: whether it holds a telling word, whether it may hold a run, and its concepts that messages have and have not.

        A text with a run has a long word of made-up Latin, or stand-in words enough.
        """
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        telling, runs, meaning, other = False, 0, 0, 0
        for w in words:
            of = seen.get(w)
            if of is None:
                plain, ideas = typed([w])
                low = w.lower()
                run = RUN if len(low) >= 6 and _LATIN.match(low) and low not in STOP else 3 * _stand_in(low)
                known = sum(t in self.messages for t in ideas)
                of = seen[w] = (not self.anchors.isdisjoint(plain), run, known, len(ideas) - known)
            telling |= of[0]
            runs += of[1]
            meaning += of[2]
            other += of[3]
        return telling, runs >= RUN, meaning, other

    def message(self, ideas: list[str]) -> tuple[str | None, float]:
        """The same for a window of concepts and the messages of pages; several of them together may contain it too."""
        told = Counter(ideas)
        known = {t: n * self.idf[t] for t, n in told.items() if t in self.messages}
        if not known:
            return None, 0.0
        of_all = sum(known.values())
        total = of_all + self.unknown_concept * sum(n for t, n in told.items() if t not in known)
        share = of_all / total
        if share < MESSAGE_COVERED:
            return None, share
        scores: dict[int, list[float]] = {}
        for t, mass in known.items():
            for e in self.told[t]:
                both = scores.setdefault(e, [0.0, 0.0])
                both[0] += mass
                both[1] += self.idf[t]
        best, label = 0.0, None
        for e, (mass, met) in scores.items():
            if met >= MATCHED * self.mass[e] and mass / total > best:
                best, label = mass / total, self.labels[e]
        if best >= MESSAGE_COVERED:
            return label, best
        if len(known) > 1 and share >= MIXED:
            return ("notice" if "\x01script" in known or "\x01check" in known else "error"), share
        return None, share

    def slotted(self, ts: list[str]) -> bool:
        """Whether a window with a slot is one of unfilled text: an exemplar that holds its type of slot lies in it, or contains it, and none of talk does."""
        distinct = set(ts)
        if len(distinct & TALK) > 1 or self.coverage([t for t in ts if t not in _TYPED])[0] == "talk":
            return False
        if "\x00slot" not in distinct:
            return self.coverage(ts)[0] == "slot"
        return any(
            self.labels[e] == "slot" and sum(self.idf[t] for t in self.exemplars[e] & distinct) >= self.mass[e] for e in self.postings.get("\x00slot", ())
        )


def vocabulary() -> frozenset:
    return frozenset(t for _, ts in _exemplars() for t in ts)


def _unfenced(text: str) -> tuple[str, bool]:
    """A text without fenced code, and whether it is HTML, then without comments that hold no slot."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    html = bool("<" in text and _HTML.search(_INLINE.sub(" ", text)))
    return (_COMMENT.sub(lambda m: m[0] if SLOT.search(m[0]) else " ", text) if html else text), html


def _line(raw: str, html: bool) -> tuple[str, str]:
    """A line without inline code and markup, and the same with its slots and runs typed; slots in a line of code stay as they are."""
    line = _INLINE.sub(" quoted ", raw) if "`" in raw else raw
    if html:
        line = _TAG.sub(lambda m: m[0] if SLOT.fullmatch(m[0]) else " . ", line)
    slots = _TRIGGER.search(line) and not _CODE.search(line)
    line = _MARKUP.sub("", line if line.isascii() else unicodedata.normalize("NFKC", line)).strip()
    return line, typed_slots(line) if slots else line


def judge(text: str | None, index: Index) -> str | None:
    """Why a text is residue: slot, filler, announcement, error or notice; None for content, null and blank texts."""
    return verdict(text, index)[0]


def verdict(text: str | None, index: Index) -> tuple[str | None, float]:
    """The reason, and the coverage of the window, paragraph or text that gave it."""
    if not text or not text.strip():
        return None, 0.0
    whole = text if text.isascii() else unicodedata.normalize("NFKC", text)
    words = _WORD.findall(_OPEN.sub("JavaScript", whole))
    # what can be said of the text as a whole spares a look at most of its lines
    slots = bool(_TRIGGER.search(text))
    telling, runs, meaning, other = index.survey(words)
    # more words than this outside of messages, and they are too many, as the text has no more terms in all
    script = not whole.isascii() and bool(_CJK.search(whole))
    allowed = REST * (len(whole) if script else len(words) + text.count("`"))
    if not script and "|" not in text and "<" not in text and not _FRAMES.search(text) and other > index.most_other * meaning + allowed:
        allowed = -1.0
    total = rest = messages = headings = 0
    message, covered, meant = None, 0.0, set()
    text, html = _unfenced(text)
    for raw in text.splitlines():
        alive = rest <= allowed
        if not (alive or runs and (html or typed_runs(raw) is not raw) or slots and _TRIGGER.search(raw) or telling and not index.anchors.isdisjoint(terms(raw if raw.isascii() else unicodedata.normalize("NFKC", raw)))):
            continue
        line, shown = _line(raw, html)
        if not line:
            continue
        slot = shown is not line
        if runs and not slot:
            shown = typed_runs(line)
        if _FRAME.match(line):
            message = message or "error"
            meant.add("\x01error")
            continue
        if not slot and "|" in line and all(len(x.split()) <= 3 for x in _BAR.split(line)):
            continue  # a bar of navigation
        words_of_line = filler = 0
        label_of_line, part_of_line = None, 0.0
        for window in _SENTENCE.split(shown):
            ts, ideas = typed(_words(window))
            if not ts and not ideas:
                continue
            if slot and any(t in ts for t in _TYPED):
                if index.slotted(ts):
                    return "slot", 1.0
                ts = [t for t in ts if t not in _TYPED]
            label, part = index.coverage(ts)
            n = len(ts)
            words_of_line += n
            total += n
            if label in ("filler", "announcement"):
                filler += n
                label_of_line, part_of_line = label_of_line or label, max(part_of_line, part)
            elif label != "navigation" and rest <= allowed:
                said, part = index.message(ideas) if label != "talk" else (None, 0.0)
                if said:
                    message, covered = message or said, max(covered, part)
                    meant.update(ideas)
                    messages += n
                elif part >= PARTLY:
                    rest += sum(t not in index.messages for t in ideas)
                elif _heading(window, ts):
                    headings += n
                else:
                    rest += n
        if words_of_line and filler >= PARAGRAPH * words_of_line:
            return label_of_line, part_of_line
    enough = messages > 2 or not meant.isdisjoint(STRONG) or len(meant & index.messages) > 1
    return (message, covered) if message and enough and headings <= messages and rest <= REST * total else (None, 0.0)


def _heading(window: str, ts: list[str]) -> bool:
    """A title or path of one or two words around a message, which is no content of its own."""
    return len(ts) <= 2 and not re.search(r"[.!?。！？]$", window)


def _seen(text: str, known: frozenset, memo: dict[str, tuple[str, ...]]) -> set[str]:
    """The terms of a text, in either view, that exemplars have."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    if len(memo) > 500_000:
        memo.clear()
    out: set[str] = set()
    for w in set(_WORD.findall(_OPEN.sub("JavaScript", text))):
        some = memo.get(w)
        if some is None:
            plain, ideas = typed([w])
            some = memo[w] = tuple(known.intersection([*plain, *ideas]))
        if some:
            out.update(some)
    return out


def frequencies(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """The number of texts, and of those with each term of the exemplars. Their vocabulary bounds what reaches the driver."""
    known = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, memo = Counter(), 0, {}
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                if t:
                    held.update(_seen(t, known, memo))
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *held], pa.string()), pa.array([n, *held.values()], pa.int64())], ["term", "n"]
        )

    rows = docs.select(text).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r[0]: r[1] for r in rows}
    return counts.pop("", 0), counts


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, reason, coverage): the texts that are residue, one row per row that is.

    coverage is the share of the TF-IDF mass of the window that exemplars
    contain; for a slot it is 1, as the exemplar of its notation lies in it.

    Null, empty and blank texts are none; texts are read whole; other columns
    are ignored; an empty table gives no rows.
    """
    documents, frequency = frequencies(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((documents, frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for b in batches:
            found = [verdict(t, index) for t in b.column(1).to_pylist()]
            at = [i for i, (r, _) in enumerate(found) if r]
            if at:
                reasons, parts = zip(*(found[i] for i in at))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(reasons, pa.string()), pa.array(parts, pa.float64())], [key, "reason", "coverage"]
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, reason string, coverage double")

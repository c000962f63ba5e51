"""Template residue, filler, error pages and script notices in document texts.

Each kind has its own grammar, one regular expression per delimiter style or
language, run by the JVM over whole texts; grammars of Chinese run only over texts
with Han characters. What a grammar finds is looked for again without the passages
that only speak of such things: fenced code, runs of code lines, settings in JSON,
sentences about macros, syntax, markers or a wording that is quoted, and, for
slots, sentences near which template languages are named again and again. A text
that is mostly code, or names template languages often for its length, is a
tutorial; nothing in it is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A slot's name: words of any script, joined by space, dot, dash or underscore.
_WORD = r"[\p{L}][\p{L}\p{M}\p{N}]*"
_NAME = rf"(?=[\p{{L}}\p{{N}} ._-]{{2,60}}){_WORD}(?:[ ._-]{{1,2}}[\p{{L}}\p{{N}}]+){{0,6}}"
_LONG = rf"(?=[^\s]{{3}}|[\p{{IsHan}}]{{2}}){_NAME}"

#: Codes that stand in angle brackets in ordinary use, and tags of HTML.
ORDINARY_ANGLED = (
    "LLOQ ULOQ LOQ LOD BLQ ALQ BLOQ QNS NA ND NR NC a b i p u br hr li ol ul td th tr em div sub sup img "
    "html body head span table tbody strong title h1 h2 h3 h4 h5 h6 font center code pre section article nav footer "
    "header button form input label select option script style link meta iframe video audio canvas svg path small big "
    "blockquote figure"
).split()

#: What slots in quotation marks name; other words in such marks are quoted.
_FIELDS = (
    r"country|product|version|indication|reviewer|author|lot|batch|date|title|subject|sample|site|sponsor|protocol|visit|data|dose|study|"
    r"name|number|address|patient|centre|center|city|titre|lieu|pays|produit|numéro|protocole|promoteur|essai|título|lugar|lote|fecha|país|"
    r"número|protocolo|promotor|estudio|titel|ort|charge|datum|land|prüfplannummer|sponsorname|nom|nombre"
)

#: Unfilled slots, by delimiter.
SLOT_GRAMMARS = {
    "double_brace": rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    "tag": rf"\{{%=?\s*{_NAME}\s*%\}}",
    "dollar": rf"\$\{{\s*{_NAME}\s*\}}",
    "brace": rf"(?<![\p{{L}}\p{{N}}$\\}}{{])\{{{_LONG}\}}(?!\}})",
    "double_angle": rf"<<\s*{_NAME}\s*>>",
    "angle": rf"(?<!<)<(?!(?i:{'|'.join(ORDINARY_ANGLED)})>){_LONG}>(?!>)",
    "guillemet": rf"«(?=[^»]*[_.]|[^»]*[a-z][A-Z]|[A-Z]{{3,}}[ A-Z]*»|(?iu:{_FIELDS}))[\p{{L}}][\p{{L}}\p{{N}}]*(?:[ ._][\p{{L}}\p{{N}}]+){{0,3}}»",
    "double_bracket": rf"\[\[\s*{_NAME}\s*\]\]",
    "at": rf"@@{_NAME}@@",
    "hash": rf"(?<![\p{{L}}\p{{N}}#])#{_LONG}#(?!#)",
    "percent": r"(?<![\p{L}\p{N}%])%(?=[^%]{3})[\p{L}]+(?:[ ._][\p{L}]+){0,3}%(?![\p{L}\p{N}])",
    "question": r"(?<![^\s:：(])\?(?=[^?]{3})[\p{L}]+(?:[ ._][\p{L}]+){0,3}\?(?![\p{L}\p{N}])",
    "underscore": r"(?<![\p{L}\p{N}_])__(?=[^_\s]{2})[\p{L}][\p{L}\p{N}]*(?:[ ._][\p{L}\p{N}]+){0,3}__(?![\p{L}\p{N}_])",
    "asked": r"(?i)[\[<{(（【](?:please\s+)?(?:insert|enter|type|fill in|add|specify|select|choose|provide|your)\s[^\]>})）】\n]{1,60}[\]>})）】]",
    "left_open": r"(?i)[\[<{(][^\[\]<>{}()\n]{1,60}(?:to be (?:completed|added|confirmed|filled|provided|determined|inserted|supplied)|TBC|TBD|TODO|à compléter|à renseigner|por completar|a completar|einfügen|eintragen|ergänzen|ausfüllen)\s*[\]>})]",
    "asked_other": r"(?i)[\[<{(](?:bitte|insérer|inserer|saisir|indiquer|insertar|introducir|indicar|TODO|TBD|TBC)[\s:][^\[\]<>{}()\n]{1,60}[\]>})]",
    "tbd": rf"\bTB[DCA]\s?\[\s*{_NAME}\s*\]|\[(?:TBD|TBC|TBA|TODO)\]",
    "blank_line": r"_{4,}|＿{3,}",
    "marks": r"\[(?:\s*(?:X{2,}|x{2,}|×{2,}|●|•|○|■|□|_+|\?{2,}|-{2,})\s*|\s{2,})\](?!\()",
    "crosses": r"[×Ｘ]{2,}[年月日号]|[×Ｘ]{4,}|(?<![A-Za-z])XX+年|(?<![A-Za-z])X{4,}(?![A-Za-z])",
    "asked_zh": r"[\[【〔（(《{<](?:此处|请|在此)?(?:插入|填写|填入|输入|补充|待补充|待填写?|待定|待补)[：:]?[^\]】〕）)》}>\n]{0,30}[\]】〕）)》}>]",
    "open_zh": r"[\[【〔（(《{<][^\[【〔（(《{<\n\]】〕）)》}>]{1,30}(?:待填写?|待补充?|待定|待确认)[\]】〕）)》}>]|[〔\[【][^〕\]】\n]{1,30}[〕\]】](?:待定|待填|待补)",
}

def _either(words: str) -> str:
    """A pattern for any of the words, parted by bars, in which common beginnings are tried once."""
    tree: dict = {}
    for word in words.split("|"):
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ends = "" in node
        parts = [c + pattern(n) for c, n in sorted(node.items()) if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)}){'?' if ends else ''}" if ends or len(parts) > 1 else parts[0]

    return pattern(tree)


_LATIN = (
    "lorem|ipsum|dolor|amet|consectetur|consectetuer|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|"
    "enim|veniam|quis|nostrud|ullamco|laboris|nisi|aliquip|commodo|duis|aute|irure|voluptate|velit|esse|cillum|fugiat|"
    "nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|culpa|officia|deserunt|mollit|vitae|lectus|massa|risus|"
    "eros|tellus|felis|sapien|odio|purus|vestibulum|pellentesque|morbi|tristique|senectus|netus|malesuada|fames|turpis|"
    "egestas|mauris|cras|justo|donec|nunc|integer|feugiat|scelerisque|varius|vivamus|fermentum|leo|quam|pulvinar|etiam|"
    "ut|et|in|id|non|ac|at|nec|orci|urna|porta|augue|arcu|diam|libero|nibh|neque|ligula|metus|mi|sem|sit|ante|est|eget"
)
_FILLER_ZH = "示例文字|示例文本|此处为占位文本|占位文本|占位文字|此处为示例|替换为您的内容|在此输入内容|正文正文|标题标题|标题标题标题|测试测试|内容内容|文字文字|某某某某|这里是正文内容"

#: Filler in place of content.
FILLER_GRAMMARS = {
    "latin": rf"(?i)\b(?:lorem ipsum|lipsum)\b|(?:^|[\s.,])(?:{_either(_LATIN)}[\s.,]+){{4}}{_either(_LATIN)}\b",
    "english": (
        r"(?i)\b(?:(?:body |your |main )?(?:text|title|content|heading|copy|paragraph) (?:goes|comes) here"
        r"|(?:your|insert|add|enter) (?:own )?(?:text|content|title|heading|copy|paragraph|name|words) (?:here|in this (?:spot|place|space))|replace this (?:with|text|paragraph|by)"
        r"|(?:write|type|put) [\p{L} ]{2,40} here[.!]|(?:beispiel|muster|platzhalter)text[.!]|texte? (?:ici|aquí|hier)[.!]"
        r"|(?:dummy|placeholder|filler) (?:copy|text)[ .,]+(?:dummy|placeholder|filler) (?:copy|text)"
        r"|this is (?:a |some )?(?:dummy|placeholder|filler|sample) (?:text|copy|paragraph)"
        r"|sample (?:paragraph|text|copy)[,;:]? (?:swap|replace|delete|remove)|swap before use|example only[,;]? delete"
        r"|blah(?:[ ,]+blah){2,}|text(?: text){3,})"
    ),
    "repeated_word": r"(?i)(?<![\p{L}\p{N}])(\p{L}{3,12})(?:[\s,.]+\1(?![\p{L}\p{N}])){4}",
    "repeated_phrase": r"(?<!\p{IsHan})(\p{IsHan}{2,10}?)(?:[\s，、。]*\1){3}",
    "chinese": rf"(?:^|[\s，。！？；、,.:：!?;])(?:(?:{_FILLER_ZH})[\s，。、,.]*)+(?=$|[\s，。！？；、,.!?;]|(?<=[\s，。、,.]))",
}

#: Messages of a failing page or viewer to its reader.
ERROR_GRAMMARS = {
    "status": (
        r"(?im)(?:^|[\n.!?])\s*(?:HTTP(?:/\d\.\d)?\s*)?[45]\d\d\s*[:\-–]?\s*(?:Page not found|Not found|Internal server error|Bad gateway|"
        r"Gateway time|Service unavailable|Access denied|Forbidden|Sign-?in required|Unauthori[sz]ed|Bad request|Too many requests)"
        r"|(?:^|[\n.!?])\s*HTTP(?:/\d\.\d)? ?[45]\d\d\s*(?:$|[\n.!:])"
    ),
    "english": (
        r"(?i)(?<![\p{L}\p{N}])(?=[pibgsaycluwtvd])(?:Page not found\b|Internal server error\b|Bad gateway\b|Gateway timed? ?out\b|Service unavailable\b|Access denied\b(?! to)|"
        r"Sign-?in required\b|You do not have permission to|You are not (?:allowed|authori[sz]ed) to|Something went wrong\b|"
        r"Your session (?:has |was )?(?:expired|timed out)|Sign in again to|Log in again to|Unhandled exception in|"
        r"(?:viewer|browser|page|app) failed to load|We could not find the|We can(?:'|no)t find the page|link may be old or mistyped|"
        r"This (?:folder|page|file) was moved by its owner|database did not answer in time|Try again in a few minutes|"
        r"Too many requests\b|under maintenance[.!,])|(?:^|[\s.!?])Oops!"
    ),
    "chinese": (
        r"(?=[错您服页文登会无请系抱])(?:错误\s*\d{3}\s*[：:]|您没有权限(?:查看|访问)|服务器内部(?:出错|错误)|您访问的页面不存在|页面(?:不存在|未找到|找不到)|文件加载失败|"
        r"登录已(?:超时|过期)|会话已(?:超时|过期)|无法连接数据库|请求过于频繁|系统维护中|请稍后重试|请重新登录|抱歉[！!])"
    ),
    "german": r"(?i)(?<!\p{L})(?=[idszkm])(?:Interner (?:Server)?fehler beim|(?:Die )?Seite wurde (?:leider )?nicht gefunden|Ihre Sitzung ist abgelaufen|Zugriff verweigert[.!]|Zugriff auf (?:dieses|das) Dokument verweigert|keine Berechtigung, dieses|melden Sie sich (?:bitte )?(?:erneut|neu) an)",
    "french": r"(?i)(?<!\p{L})(?=[puvai])(?:page est introuvable|page introuvable|Une erreur interne (?:empêche|s.est)|Votre session a expiré|Accès refusé[ .!]|Accès (?:au|à ce) document refusé|identifiez-vous de nouveau|vous n.avez pas (?:le droit|l.autorisation))",
    "spanish": r"(?i)(?<!\p{L})(?=[enpsaiv])(?:Error interno al|No encontramos la página|página no encontrada|Su sesión (?:ha )?(?:caducado|expirado|caducó|expiró)|Acceso denegado(?:[.!]| a este documento)|no tiene permiso para|inicie sesión de nuevo|vuelva a iniciar)",
}

ERROR_GRAMMARS["other"] = (
    r"(?i)(?<!\p{L})(?=[pies])(?:Pagina (?:web )?non trovata|Pagina niet gevonden|Página não encontrada|Errore interno del server|Interne serverfout|Erro interno do servidor|"
    r"Sessione scaduta|Uw sessie is verlopen|Sua sessão expirou)|ページが見つかりません|お探しのページは|サーバー(?:内部)?エラー|アクセスが拒否され|セッションの有効期限が切れ"
)
#: A whole text that is short, names a failure with a status and asks to act, is an error page in whatever words.
SHORT_PAGE = 200
STATUS_PAGE = r"(?iu)^\W{0,5}(?:http\S{0,4} ?)?(?:(?:error|erreur|fehler|errore|fout|erro|エラー|오류|错误|錯誤)[\s:#：-]{0,3})?[45]\d\d(?!\d)[\s:：|.-]{0,4}(?:\p{L}|$)"
ACT_NOW = (
    r"(?iu)\b(?:try again|retry|reload|refresh|go back|return to|log ?in|sign ?in|contact (?:your|the|us)|erneut|neu laden|zurück|réessay|recharg|revenir|connectez|"
    r"inténtelo|intente|vuelva|recargue|riprova|ricarica|torna|probeer|ververs|tente novamente|recarregue)\b|再試行|もう一度|再読み込み|다시|重试|刷新|返回|重新登录|联系管理员"
)

#: Notices that scripts are needed.
SCRIPT_GRAMMARS = {
    "english": (
        r"(?i)(?<![\p{L}\p{N}])(?=[jpnsryva])(?:JavaScript is (?:disabled|turned off|switched off|not enabled|required)|(?:please |need to )(?:enable|turn on|allow|activate) (?:JavaScript|scripts)|"
        r"Scripts are (?:switched|turned) off|Scripts are disabled|(?:needs|requires) (?:JavaScript|scripts) to (?:run|work)|Your browser blocks scripts|"
        r"(?:viewer|page|site|app) (?:needs|requires) (?:JavaScript|scripts))"
    ),
    "chinese": (
        r"(?<!需要)请?启用浏览器脚本|请(?:启用|开启|允许)[^。！？\n]{0,8}(?:脚本|JavaScript)|允许运行\s*JavaScript|脚本已被(?:拦截|禁用|阻止)|检测到脚本被(?:禁用|拦截)|"
        r"(?:页面|网页)需要脚本支持|浏览器(?:未开启|未启用|不支持|禁用了?|已禁用)\s*(?:JavaScript|脚本)"
    ),
    "german": r"(?i)(?<!\p{L})(?=[jbaso])(?:JavaScript ist (?:ausgeschaltet|deaktiviert|abgeschaltet)|Browser blockiert Skripte|(?:aktivieren|schalten) Sie (?:bitte )?(?:JavaScript|Skripte)|Ohne (?:Skripte|JavaScript) keine|Ansicht (?:braucht|benötigt) Skripte|Skripte sind (?:aus|blockiert|deaktiviert))",
    "french": r"(?i)(?<!\p{L})(?=[easj])(?:exige des scripts|Activez (?:JavaScript|les scripts)|scripts sont (?:bloqués|désactivés)|JavaScript est (?:coupé|désactivé))",
    "spanish": r"(?i)(?<!\p{L})(?=[sjahvp])(?:scripts están (?:bloqueados|desactivados)|JavaScript está (?:apagado|desactivado|deshabilitado)|(?:Active|Habilite) (?:JavaScript|los scripts)|(?:vista|página) (?:exige|necesita|requiere) scripts)",
}

SCRIPT_GRAMMARS["other"] = (
    r"(?i)(?<!\p{L})(?=[jash])(?:JavaScript (?:è disattivato|è disabilitato|is uitgeschakeld|está desativado)|(?:Abilita(?:re)?|Attiva(?:re)?|Schakel|Habilite|Ative) (?:o |il )?JavaScript)"
    r"|JavaScript\s*(?:を有効|が無効|を許可)|스크립트를 (?:허용|사용)"
)

_META = r"(?i)\b(?:macros?|syntax|style fields?|notation|separators?|regex(?:es)?|regular expressions?|escape sequence|(?:is|are) defined in|tags? such as|fields? such as|written as|kept as typed)\b|语法|宏|正则|分隔符|格式的字段|形如"
#: A wording that is quoted: it is named as a word, phrase or message, and something is said of it.
_MENTION = (
    r"(?iu)\b(?:words?|phrases?|messages?|terms?|strings?|expressions?|wording|notices?|captions?)\b[^\n]{0,90}?\b(?:is|are|was|were) (?:only |just |never |always |often |usually )?"
    r"(?:used|shown|written|displayed|defined|meant|quoted|listed|kept|typed|explained|called|understood|an example)\b"
    r"|\b(?:das wort|die meldung|der ausdruck|le mot|le message|l.expression|la palabra|el mensaje|la expresión)\b[^\n]{0,90}?\b(?:wird|bedeutet|steht|est|signifie|désigne|se usa|significa|es)\b"
    r"|(?:一词|字样|该提示语|这句话|术语)[^\n。]{0,40}(?:表示|是指|指的是|用于|仅)"
)
_STATEMENT = (
    r"(?:def |return |import |from \w+ import |class |for \w+ in |if .*:$|SELECT |INSERT |#include|function |var |const |let |raise |throw |print\(|"
    r"[a-z_][\w.]*(?:\[[^\]\n]*\])? ?[+*/-]?= ?(?:[rbf]?[\"'`]|[\[{(\d]|[a-zA-Z_][\w.]*\()|[a-z_][\w.]*\([^)\n]*\);?\s*$)"
)
_CODE = rf"```|(?m:^\s*{_STATEMENT})|\{{\s*\""
_CODE_LINE = rf"(?m)^\s*{_STATEMENT}.*$"

#: Passages that only speak of such things: fenced code, lines of code, settings in JSON.
CODE_PASSAGES = (
    r"(?s)```.*?```|```.*?(?=\n\s*\n|$)",  # a fence left open ends at the next blank line
    _CODE_LINE,
    r"\{\s*\"[^{}]*\}",
)

#: Template languages are spoken of where at least TUTORIAL_MENTIONS names lie in a sentence and the
#: NEAR ones on either side of it. A tutorial: so many names, one in NEAR * 2 + 1 sentences, or code on most lines.
_TUTORIAL = r"(?i)\b(?:jinja2?|mustache|handlebars|templat(?:e|ing) (?:engine|language)|liquid tags?)\b"
TUTORIAL_MENTIONS, NEAR = 2, 2


def _any(patterns: dict[str, str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


#: Every slot begins with one of these; other characters are passed over at once.
_SLOT_START = r"(?=[\[{<$«@#%?_＿【〔（(《×ＸXT])"


#: Grammars that need Han characters.
HAN_GRAMMARS = {"chinese", "repeated_phrase"}


def discounted(text: Column, spoken: str, tutorials: bool) -> Column:
    """``text`` without code, settings and sentences that match ``spoken``; empty if it
    is mostly code or, with ``tutorials``, about template languages.

    Sentences are split once and filtered, so the cost stays linear in the text.
    """
    lines = F.regexp_count(text, F.lit(r"(?m)^.*\S"))
    code = F.regexp_count(text, F.lit(_CODE_LINE)) * 2 > lines
    names = F.regexp_count(text, F.lit(_TUTORIAL))
    for pattern in CODE_PASSAGES:
        text = F.regexp_replace(text, pattern, " ")
    sentences = F.filter(F.split(text, r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n"), lambda s: s.rlike(r"\S"))
    width = NEAR * 2 + 1
    tutorial = code | ((names >= TUTORIAL_MENTIONS) & (names * width >= F.size(sentences)))
    kept = F.filter(sentences, lambda s: ~s.rlike(spoken))
    if not tutorials:
        return F.when(code, "").otherwise(F.array_join(kept, "\n"))
    named = F.transform(sentences, lambda s: F.regexp_count(s, F.lit(_TUTORIAL)))
    pad = F.array_repeat(F.lit(0), NEAR)
    near = F.arrays_zip(sentences.alias("s"), *[F.slice(F.concat(pad, named, pad), i + 1, F.size(sentences)).alias(f"n{i}") for i in range(width)])
    apart = F.filter(near, lambda x: ~x["s"].rlike(spoken) & (sum((x[f"n{i}"] for i in range(width)), F.lit(0)) < TUTORIAL_MENTIONS))
    local = F.transform(apart, lambda x: x["s"])
    return F.when(tutorial, "").otherwise(F.array_join(F.when(names >= TUTORIAL_MENTIONS, local).otherwise(kept), "\n"))


def _found(text: Column, grammars: dict[str, str]) -> Column:
    """Whether a grammar matches; those of Chinese are tried only where there are Han characters."""
    han = {k: p for k, p in grammars.items() if k in HAN_GRAMMARS}
    found = text.rlike(_any({k: p for k, p in grammars.items() if k not in han}))
    return found | (text.rlike(r"\p{IsHan}") & text.rlike(_any(han))) if han else found


def _quoted(text: Column, grammars: dict[str, str]) -> Column:
    """Whether the grammars match only in passages that speak of what they look for."""
    return text.rlike(f"{_META}|{_MENTION}|{_CODE}|{_TUTORIAL}") & ~_found(discounted(text, f"{_META}|{_MENTION}", False), grammars)


def residue_kinds(text: Column) -> Column:
    """The kinds found in ``text``: an array of slot, filler, error and script.

    Null, blank and empty texts give an empty array. Whole texts are searched.
    Only a text with a find and something to discount is searched again.
    """
    slots = f"{_SLOT_START}(?:{_any(SLOT_GRAMMARS)})"
    speaks = text.rlike(f"{_META}|{_CODE}|{_TUTORIAL}")
    slot = text.rlike(slots) & F.when(speaks, discounted(text, _META, True).rlike(slots)).otherwise(True)
    page = (F.length(text) <= SHORT_PAGE) & text.rlike(STATUS_PAGE) & text.rlike(ACT_NOW) & ~text.rlike(f"{_META}|{_MENTION}|{_CODE}")
    kinds = F.array_compact(
        F.array(
            F.when(slot, F.lit("slot")),
            F.when(_found(text, FILLER_GRAMMARS) & ~_quoted(text, FILLER_GRAMMARS), F.lit("filler")),
            F.when((_found(text, ERROR_GRAMMARS) & ~_quoted(text, ERROR_GRAMMARS)) | page, F.lit("error")),
            F.when(_found(text, SCRIPT_GRAMMARS) & ~_quoted(text, SCRIPT_GRAMMARS), F.lit("script")),
        )
    )
    return F.coalesce(kinds, F.array().cast("array<string>"))


def residue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``documents`` with ``residue_kinds``; a document with an empty array is clean."""
    return documents.withColumn("residue_kinds", residue_kinds(F.col(text)))


def with_residue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The distinct keys of documents with residue, and its kinds."""
    found = residue(documents.select(key, text), key, text).where(F.size("residue_kinds") > 0)
    return found.select(key, "residue_kinds").distinct()


def without_residue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``documents`` without those that hold residue; null and blank texts stay."""
    return documents.where(F.size(residue_kinds(F.col(text))) == 0)

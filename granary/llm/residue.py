"""Problem 9: unfilled placeholders, filler, error pages and notices that scripts are needed."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import prod

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The words of the customary dummy text.
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vestibulum pellentesque aenean aliquam ante arcu auctor augue bibendum blandit condimentum congue cras curabitur cursus dapibus diam dictum dignissim donec egestas eget eleifend elementum erat eros etiam euismod facilisis faucibus felis fermentum feugiat fringilla fusce gravida hendrerit iaculis imperdiet interdum justo lacinia lacus laoreet lectus libero ligula lobortis luctus maecenas massa mattis mauris metus molestie morbi nec neque nibh nisl nullam nunc odio orci ornare pharetra phasellus placerat porttitor posuere praesent proin pulvinar purus quam quisque rhoncus risus rutrum sagittis sapien scelerisque semper sodales sollicitudin suscipit suspendisse tellus tempus tincidunt tortor tristique turpis ullamcorper ultrices urna varius vehicula vel venenatis vitae vivamus viverra volutpat vulputate perspiciatis unde omnis iste natus voluptatem".split()

#: Fields that forms leave open; a single word between doubtful delimiters counts only if it is one of them.
FIELD = r"(?:first|last|full|given|family|company|client|customer|party|parties|counterparty|vendor|supplier|buyer|seller|landlord|tenant|borrower|lender|employee|employer|name|title|position|address|street|city|town|state|country|county|jurisdiction|court|zip|postcode|date|day|month|year|fiscal|effective|amount|price|purchase|sum|total|currency|number|no|case|case_no|docket|invoice|account|reference|ref|signatory|signature|email|e-mail|phone|telephone|fax|website|url|subject|description|text|content|body|placeholder|product|project|department|recipient|sender|user|username|organi[sz]ation|location|venue|deadline|salary|percentage|nombre|fecha|importe|dirección|direccion|ciudad|empresa|cliente|nom|prénom|prenom|montant|adresse|ville|société|societe|vorname|nachname|betrag|datum|anschrift|ort|firma|kunde|destinataire|expéditeur|destinatario|remitente|empfänger|absender|monto|lieu|lugar|unterschrift)"
_NAME = rf"(?:{FIELD}(?:[ _.\-]+[\p{{L}}\d]+){{0,4}}|(?:[\p{{L}}\d]+[ _.\-]+){{0,4}}{FIELD})"
_SNAKE = r"[\p{L}][\p{L}\d]*(?:_[\p{L}\d]+)+"
_CAMEL = r"[\p{Lu}][\p{Ll}\d]+(?:[\p{Lu}][\p{Ll}\d]*)+"
_ASK = r"(?:please\s+)?(?:insert|enter|your|add|type|fill\s+in|name\s+of|date\s+of|amount\s+of|choose|select|specify|provide|describe|tbd|tbc|to\s+be\s+(?:inserted|completed|determined|confirmed|supplied)|hier|bitte|einfügen|eingeben|insérer|inserer|saisir|votre|insertar|introducir|introduzca|su)"
#: What stands in brackets by an editor or a censor.
_EDITED = r"(?:sic|reserved|redacted|omitted|deleted|confidential|sealed?|illegible|inaudible|emphasis|citations?|internal|footnotes?|signed|seal|blank|unclear|withheld|translation|note|applause|laughter|recess|exhibit|page|table|figure|image|photo|chart|video|map|intentionally|privileged|classified|names?\s+(?:redacted|withheld|omitted))"

#: Each rule is a regular expression, tried on each line or sentence. The first list has one grammar for each pair of delimiters.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{0,80}\}\}",
    r"\{%[^{}\n]{0,80}%\}",
    r"[$#]\{[^{}\n]{1,60}\}",
    r"<%[^\n]{0,80}?%>",
    r"<\?(?:php|=)[^\n]{0,120}",
    rf"\[\[\s*(?:{_NAME}|{_SNAKE}|{_ASK}\b[^\[\]\n]{{0,60}})\s*\]\]",
    rf"\(\(\s*(?:{_NAME}|{_SNAKE}|{_ASK}\b[^()\n]{{0,60}})\s*\)\)",
    rf"<<\s*(?:{_NAME}|{_SNAKE}|{_CAMEL}|{_ASK}\b[^<>\n]{{0,60}})\s*>>",
    rf"«(?:{_NAME}|{_SNAKE}|(?-i:{_CAMEL})|{_ASK}\b[^«»\n]{{0,60}})»",
    rf"<(?:{_SNAKE}|{_ASK}\b[^<>\n]{{0,60}}|(?-i:[A-Z][A-Z _]{{2,40}})|{_NAME})>",
    rf"&lt;\s*(?:{_NAME}|{_SNAKE}|{_ASK}\b[^&\n]{{0,60}})\s*&gt;",
    rf"(?<![\w{{$#%])\{{(?:{_NAME}|{_SNAKE})\}}(?!\}})",
    rf"\[\s*{_ASK}\b[^\[\]\n]{{0,60}}\]",
    rf"\[(?!\s*{_EDITED}\b)(?:{_SNAKE}|(?-i:[A-Z][A-Z]+(?:[ _\-][A-Z]+){{0,4}})|{_NAME})\]",
    r"\[\s*[_•●▪∙○◦]+\s*\]|\[[ \t]{2,}\]",
    r"\[%[^\[\]\n]{0,80}%\]|\{#[^{}\n]{0,80}#\}|</?#\w+[^<>\n]{0,60}>|\{[$!]\p{L}[\w.]*\}|\*\|\w+\|\*|##[\p{L}_ ]+##|(?<![\w#])#(?-i:[A-Z_]{3,})#(?!\w)|(?<!\w)__(?-i:[A-Z][A-Z_]+)__(?!\w)",
    rf"(?<![\w$])\$(?:[a-g]|[h-n]|[o-u]|[v-z])[\p{{L}}_]+\$(?![\w$])|(?<![\w$])\$(?-i:{FIELD})\b|(?<![\w$])\$(?-i:(?:[a-g]|[h-n]|[o-u]|[v-z])[a-z]*(?:_[a-z]+)+)|%\([\p{{L}}_]+\)[sd]|(?<![\w%] )(?<![\w%])%[sd](?!\w)|(?<!\w)@(?-i:Model|ViewBag|ViewData)\.\w+",
    r"(?:^|\s)(?:dear|hello|hi|hey|bonjour|hola|hallo|liebe[rs]?|estimad[oa]s?|cher|chère|sehr geehrte[rs]?(?: herr| frau)?) (?:\[[^\[\]\n]{1,40}\]|\{[^{}\n]{1,40}\}|<[^<>\n]{1,40}>|«[^«»\n]{1,40}»|%[\p{L}_]{1,40}%)",
    r"\(\s*(?:please )?(?:insert|fill in|enter|type in)\s+[^()\n]{1,50}\)|\b(?:name|date|signature|signed|place|datum|unterschrift|fecha|firma|nom|lieu)\s*:?\s*\.{5,}",
    r"(?-i:^\W*(?:TODO|FIXME|TBD|TBC|TBA|TKTK)\W*$)",
    r"@@[\p{L}_]+@@|(?<![\w@])@(?-i:[A-Z_]{2,})@(?![\w@])",
    r"%%[\p{L}_]+%%|(?<![\w%])%(?-i:[A-Z]+(?:_[A-Z]+)*)%(?![\w%])|(?<![\w%])%\p{L}+(?:_\p{L}+)+%",
    r"(?-i:\bTB[DCA][-_:][A-Z_]{2,})",
    r"(?-i:(?:^|[\s(])(?:TODO|FIXME|TKTK)\b\s*[:(\-])",
    r"_{4,}",
    r"(?-i:\bX{2,}[/.\-]X{2,}[/.\-]X{2,}|[$€£]\s?X{1,3}(?:,X{3})+|[$€£]\s?X{2,})",
    r"(?:^|\s)(?:dear|hello|hi|cher|chère|estimad[oa]|sehr geehrte[rs]?)(?: (?:mr|mrs|ms|dr|herr|frau)\.?)? [,:](?:\s|$)",
    r"\b(?:letter|e-?mail|order|invoice|message|call|schreiben|lettre|carta) (?:of|from|dated|vom|du|de|del) [.,](?:\s|$)",
]
_MASH = r"(?:asdf\w*|qwer\w*|hjkl\w*|jkl[oöñ]?|foo|bar|baz|bla+|xxx+|abc)"
#: A word four times in a row.
REPEATED = r"(?<![\p{L}\d])(\p{L}{3,14})(?:[\s,]+\1(?![\p{L}\d])){3,}"
#: Five dummy words in a row, of which one has five letters or more (its hints); a run of short ones is a rule of its own.
LOREM_RUN = r"(?:\b(?:" + "|".join(LOREM) + r")\b[\s,.;]*){5,}"
SHORT_LOREM = r"\b(?:" + "|".join(w for w in LOREM if len(w) < 4) + r")\b(?:[\s,.;]+(?:" + "|".join(w for w in LOREM if len(w) < 4) + r")\b){5}"
FILLER = [
    LOREM_RUN,
    SHORT_LOREM,
    REPEATED,
    rf"\b{_MASH}(?:[\s,]+{_MASH}(?![\p{{L}}\d])){{2,}}",
    r"\bthis is (?:a |the )?(?:placeholder|sample|dummy|filler|example|default) (?:text|content|page|paragraph|post)\b",
    r"\b(?:placeholder|dummy|filler) (?:text|content|copy) (?:for|here|goes|only)\b",
    r"\b(?:your|insert|add|enter|type|put|write) (?:your |the |some |a |body |main |more )*(?:text|content|description|summary|title|copy|paragraph|details?)\b[^.!?\n]{0,40}\bhere\b",
    r"\b(?:text|content|copy|description|details?) (?:goes|to go|will go|comes|to come|will appear|to be (?:added|inserted|supplied)) (?:here|later|soon)",
    r"(?:^|[.:]\s+)\W*(?:insert|enter|add|type|write|put|place|paste) (?:[\p{L}]+ ){1,6}here\b",
    r"^\W*lorem ipsum\b|\blorem ipsum dolor\b",
    r"^\W*(?:a |some |the )?(?:sample|example|placeholder|dummy|test|filler|default|demo) (?:text|paragraph|content|page|post|document|title|heading|headline|copy|sentence|caption)\W*$",
    r"\b(?:text|inhalt|beschreibung|titel|name|datum) hier (?:einfügen|eingeben|ergänzen)|\bhier (?:\p{L}+ ){0,3}(?:einfügen|eingeben|ergänzen)\b|\b(?:insérer|insérez|saisir|saisissez|ajouter|ajoutez|écrire|écrivez) (?:\p{L}+ ){0,4}ici\b|\b(?:insertar|escribir|añadir|agregar|introducir|inserte|escriba|añada|agregue|introduzca) (?:\p{L}+ ){0,4}aquí\b",
    r"^\W*(?:coming soon|(?:page )?under construction|content coming soon|bald verfügbar|demnächst|bientôt disponible|próximamente|en construction|en construcción)\W*$",
    r"\bcoming soon[.!…]|\bmore (?:content|details) coming[.!…]",
    r"\bblind ?text\b[\s,]+blind ?text\b|\bhier (?:folgt|steht|kommt) (?:später |bald |noch )?(?:der |ein |ihr )?(?:text|inhalt|blindtext)|\bplatzhalter(?:text)?\b[\s,.:]+(?:platzhalter|für|hier)",
    r"\btexte? (?:à remplacer|de remplacement|à insérer|d['’]exemple|factice|fictif)|\b(?:votre|insérez (?:votre|le)) texte ici|\bfaux[- ]texte\b",
    r"\btexto (?:de (?:relleno|ejemplo|muestra|prueba)|a (?:reemplazar|sustituir|completar))|\b(?:su|inserte (?:su|el)|escriba (?:su|el)|aquí va (?:el|su)) (?:texto|contenido) aquí|\baquí va (?:el|su) (?:texto|contenido)",
    r"\[object object\]|\b(?:nan|undefined|null|none)(?:[\s,/]+(?:nan|undefined|null)){1,}\b",
    r"\b(?:click|tap|double-?click) (?:here )?to (?:edit|add|change) (?:this |your )?(?:text|title|content)",
]
MESSAGES = [
    r"\b[45]\d\d[\s:–—-]{1,3}(?:page |file )?(?:not found|forbidden|bad gateway|internal server error|service (?:temporarily )?unavailable|gateway time-?out|bad request|unauthori[sz]ed|too many requests|method not allowed|gone\b|request time-?out)",
    r"\bhttp (?:error|status)\W{0,3}(?:code )?[45]\d\d|(?:^|\W)error (?:code )?[45]\d\d\s*[–—:\-(]|^\W*error (?:code )?[45]\d\d\W*$",
    r"^\W*(?:access denied|permission denied|forbidden|not found|page not found|bad gateway|internal server error|service unavailable|gateway time-?out|unauthori[sz]ed|too many requests|bad request|server error|unexpected error|request time-?out|connection (?:refused|timed out|reset))\W*$",
    r"\byou (?:don['’]t|do not) have (?:the )?(?:permission|access|authori[sz]ation)s? to (?:access|view|see|open)",
    r"\b(?:requested )?(?:url|page|document|resource|file|address|object|link)\b[^.!?\n]{0,60}\b(?:was not|could not be|cannot be|can['’]t be|wasn['’]t|couldn['’]t be) (?:found|located|displayed|loaded)(?: on this (?:server|site)|\W*$)|\brequested url\b[^!?\n]{0,80}\bwas not found",
    r"\b(?:the )?requested (?:url|page|document|resource)\b[^.!?\n]{0,60}\b(?:not found|no longer|does not exist|doesn['’]t exist|unavailable)",
    r"\b(?:we )?(?:can['’]t|cannot|couldn['’]t|could not) find (?:the|that|this) page\b|\bthe page you (?:are|were) looking for\b|\bthis (?:page|site|website)\b[^.!?\n]{0,20}\b(?:isn['’]t|is not|is no longer|is currently not) available",
    r"\b(?:site|website|page) (?:can['’]t|cannot|can not) be (?:reached|displayed|loaded)|\btook too long to respond\W*$|\bserver did(?: not|n['’]t) respond|\b(?:dns|server) (?:address )?could not be found|^\W*(?:the |your )?connection (?:was|has been) (?:reset|refused|timed out)\b|\berr_[a-z_]{4,}",
    r"\bdatabase (?:connection )?error\W{1,3}|\berror establishing (?:a )?database connection|\b(?:sql|mysql|pdo)\W?(?:syntax )?(?:error|exception)\b|\bora-\d{5}",
    r"\bfatal error\s*:|\bparse error\s*:|\buncaught (?:exception|\w*error)|\bunhandled exception|\btraceback \(most recent call last\)|\bstack trace\s*:|\b\w+(?:exception|error) (?:at|in) [\w./\\]+[:(]\d+|\bexception in thread\b|^\s*at [\w.$]+\([\w.]+:\d+\)|\bsegmentation fault\b|\b(?:key|name|type|value|index|attribute|reference|syntax)error\s*:|\bnullpointerexception\b|^\W*(?:warning|notice|deprecated)\s*:[^\n]{0,120}\bon line \d+",
    r"^\W*too many requests\b|\byou (?:have been|are being|are) rate[- ]limited|\brate limit exceeded|\bretry after \d+ ?s",
    r"\byour (?:session|login|token|link) (?:has |is )?(?:expired|timed out)|\bplease (?:log|sign) ?in (?:again )?to (?:view|continue|read|see|access)",
    r"\b(?:we are|we['’]re|site is|service is|system is) (?:currently )?(?:down|offline|closed) for (?:scheduled |routine |planned )?maintenance|^\W*(?:scheduled|planned) maintenance\W|\bback (?:online )?at \d+[:.]\d\d",
    r"^\W*the service is (?:temporarily |currently )?(?:unavailable|overloaded)|\bservice (?:temporarily|currently) unavailable",
    r"^\W*something went wrong\b|\boops[!,.]|\b(?:an?|unexpected|unknown) (?:unexpected |unknown |internal )?error (?:has )?occurr?ed[.!]|\bplease try again later|\bplease (?:refresh|reload) (?:the|this|your) (?:page|browser)",
    r"\bchecking your browser\b|\bverify (?:that )?you are (?:a )?human|\bverifying you are human|\bprove you(?:['’]re| are) (?:not a robot|human)|\b(?:are you|i['’]?a?m not) a robot\b|\bcomplet(?:e|ing) (?:the|this) captcha|\bddos protection by\b|\bray id\s*:",
    r"^\W*(?:the |this )?file (?:may be|is|appears to be|might be) (?:corrupt(?:ed)?|damaged|expired)|^\W*(?:cannot|can['’]t|could not|failed to|unable to) (?:display|render|load|open) (?:the |this )?(?:document|page|file|resource|image|content|pdf)",
    r"\b(?:ad|script|content)[- ]?block(?:er|ing)?(?: or [\p{L} ]{0,20}block(?:er|ing)?)? (?:was |has been )?detected|\bdisable (?:your|the) (?:ad|script|content)[- ]?blocker|^\W*disable it to (?:see|view|read|continue)",
    r"\bpage introuvable|\b(?:le|la) (?:document|page|fichier) demandée?\b[^.\n]{0,20}\bn['’](?:existe|est|a)\b|\bservice (?:momentanément |temporairement )?indisponible|\bune erreur (?:est survenue|s['’]est produite)|^\W*accès (?:refusé|interdit)\W*$|\berreur (?:interne )?du serveur|\bvotre session (?:a )?expiré",
    r"\bseite (?:wurde )?nicht gefunden|\b(?:angeforderte|gesuchte)\w* (?:seite|eintrag|dokument|datei|ressource)\b[^.\n]{0,40}\b(?:nicht|existiert)|\bwartungsarbeiten\s*[:!]|\b(?:anwendung|seite|server|dienst|website) ist (?:zurzeit|zur zeit|derzeit|momentan|vorübergehend) nicht (?:erreichbar|verfügbar)|\bes ist ein (?:unerwarteter )?fehler aufgetreten|^\W*zugriff verweigert|\binterner serverfehler|\bihre sitzung ist abgelaufen",
    r"\bpágina no encontrada|\bel (?:documento|archivo|recurso) solicitado\b[^.\n]{0,30}\b(?:no|ya no)\b|\bno se (?:ha )?(?:encontró|encontrado|pudo encontrar) la página|\bservicio (?:temporalmente )?no disponible|\bse ha producido un error|^\W*acceso denegado\W*$|\berror (?:interno )?del servidor|\bsu sesión ha (?:caducado|expirado)",
]
#: What a page or a program says of itself: the thing (it or yours), and how it fails.
_PAGE = r"(?:web ?)?(?:page|site|url|portal)"
_DETERMINED = rf"(?:this|that|the|your|our) (?:requested )?{_PAGE}"
_FAILS = r"(?:(?:is|are|was)(?: not|n['’]t| no longer| currently| temporarily)+ (?:available|accessible|working|online|reachable|responding)|(?:is|was) (?:currently |temporarily )?(?:unavailable|unreachable|offline|inaccessible|overloaded)|(?:could|can)(?:not| not|n['’]t) be (?:found|loaded|displayed|reached|opened|accessed|shown)|(?:does not|doesn['’]t|no longer) exists?|(?:failed|refused) to (?:load|connect|respond|open)|has (?:been )?(?:expired|timed out|moved|removed|blocked|suspended))"
MESSAGES += [
    rf"^\W*(?:sorry\W+)?{_DETERMINED} (?:you (?:requested|asked for|are looking for|were looking for|want) )?{_FAILS}\b",
    r"^\W*(?:error|fehler|erreur)\W{0,3}(?:code\W{0,2})?\d{3,5}\b",
    r"^\W*(?:(?:we['’]re|we are|i['’]?m|so) )?(?:sorry|unfortunately|oops|whoops|uh-oh|it looks like|looks like|hmm)\b[^.!?\n]{0,30}\b(?:something|things) (?:went|has gone|have gone) wrong\b|^\W*(?:whoops|uh[- ]oh|hoppla)\b",
    r"\b(?:critical|fatal|unexpected|unknown|internal) error on this (?:web ?)?site\b|\baccess to this (?:page|site|resource|website|url|content) (?:has been|is|was) (?:denied|blocked|forbidden|restricted)|\byou (?:are not|aren['’]t) (?:authori[sz]ed|allowed|permitted) to (?:access|view|see|open) this (?:page|site|resource|website|content|directory)",
    r"\bthis (?:content|video|resource|listing|article|feature) (?:is|isn['’]t|is not) (?:currently |no longer |not )?(?:available|accessible) (?:in your (?:country|region|area)|at this time|right now)\b",
    r"^\W*(?:the |this )?session (?:has )?(?:expired|timed out|time-?out)\W*$|\bserver encountered (?:an?|some)\b|\bunable to (?:complete|process) your request\b|\bthe request could not be satisfied\b|^\W*(?:sorry\W+)?your request could not be (?:processed|completed)\b",
    r"\bno such file or directory\b|\bundefined (?:variable|index|offset|function|method|constant|property)\b\W{0,3}[\w$]|\bcannot read propert(?:y|ies)\b|\bmaximum execution time\b|\ballowed memory size\b|\bcore dumped\b|\bfailed to open stream\b|\bheaders already sent\b|\bcall to undefined\b|\bindex out of (?:range|bounds)\b|\beconnrefused\b|\betimedout\b|\benoent\b|\bnet::err",
    r"(?<!\w)#(?:ref|value|name|div/0|num|null)[!?]",
    r"\b(?:your|this) browser (?:is|version is) (?:out of date|outdated|not supported|no longer supported|unsupported)|\bunsupported browser\b|\bplease (?:update|upgrade) your browser|\byour connection is not (?:private|secure)\b|\bredirected you too many times\b",
    r"^\W*(?:loading|redirecting|please wait)\W*$|\b(?:web ?)?(?:site|page|portal|service|server|system)\b[^.!?\n]{0,20}\b(?:is|are) (?:currently )?(?:under|undergoing|in) (?:scheduled |routine |planned |urgent )?maintenance\b|^\W*we(?:['’]ll| will) be (?:right )?back (?:soon|shortly|online)\b",
    r"^\W*this (?:account|domain|site) (?:has been|is) (?:suspended|parked|disabled)\b|^\W*invalid (?:request|token|session|url|csrf token|parameter)s?\W*$",
    r"\b(?:diese|die(?: \p{L}+)?) (?:web)?seite\b[^.\n]{0,40}\b(?:nicht (?:gefunden|verfügbar|erreichbar|geladen|angezeigt)|existiert nicht)|\betwas ist schief ?(?:gelaufen|gegangen)|\bsitzung ist abgelaufen|^\W*zu viele anfragen|\bbitte versuchen sie es (?:später|erneut|noch einmal)|\bserver (?:ist überlastet|antwortet nicht)",
    r"\b(?:cette|la) page (?:demandée|que vous (?:cherchez|recherchez|demandez)|n['’]existe (?:pas|plus)|est introuvable|n['’]est (?:pas|plus) (?:disponible|accessible))|\bquelque chose s['’]est mal passé|^\W*trop de requêtes|\bveuillez réessayer|\bserveur (?:est (?:indisponible|surchargé)|ne répond pas)|\berreur interne\W*$|\bvous n['’](?:êtes pas autorisé|avez pas (?:accès|la permission|l['’]autorisation)) (?:à|d['’]) (?:accéder|afficher|voir)",
    r"\b(?:esta|la) página (?:solicitada|que (?:busca|buscas|está buscando|solicitó)|no existe|ya no existe|no está disponible|no se (?:encuentra|encontró))|\balgo salió mal|^\W*demasiadas solicitudes|\b(?:inténtelo|inténtalo) (?:de nuevo|más tarde)|\bvuelva a intentarlo|\bservidor (?:no responde|está saturado)|\bno tiene permiso para (?:acceder|ver)",
]
_TECH = r"(?:java ?script|scripts?|scripting|cookies)"
SCRIPTS = [
    rf"\b(?:please |must |need to |have to |to (?:use|view|read|see|continue)[^.\n]{{0,40}}, )(?:first )?(?:enable|activate|turn on|switch on|allow|accept|re-?enable)\b[^.!?\n]{{0,30}}\b{_TECH}\b",
    rf"(?:^|[.!?:]\s+)\W*(?:enable|activate|turn on|switch on|allow|accept)\b[^.!?\n]{{0,30}}\b{_TECH}\b",
    rf"\b(?:this|the|our) (?:site|page|website|content|app|application|document|viewer|feature|form)\b[^.!?\n]{{0,20}}\b(?:requires?|needs?|relies on|uses|works best with|depends on)\b[^.!?\n]{{0,20}}\b(?:java ?script|cookies|scripts)\b",
    r"\bjava ?script (?:is|must be|has to be|needs to be|seems to be|appears to be) (?:required|disabled|enabled|not enabled|turned off|switched off|off|needed|blocked|not available)(?: in your browser| to | for |[.!]|$)",
    rf"\byour browser (?:does not|doesn['’]t|has|is|must|needs)\b[^.!?\n]{{0,40}}\b{_TECH}\b|\b{_TECH} (?:is|are|has been|have been) (?:switched|turned) off in your browser|\b{_TECH} (?:is|are) (?:disabled|blocked|off) in your browser|\bcookies (?:must be|are) (?:enabled|required|disabled|blocked)\b|\bwithout (?:java ?script|cookies)\b[^.!?\n]{{0,30}}\b(?:cannot|can['’]t|will not|won['’]t) (?:work|load|display)",
    r"\bactiv(?:ez|er) (?:le |les )?(?:java ?script|scripts|cookies)|\b(?:java ?script|cookies) (?:est|sont|doit|doivent)\b[^.\n]{0,20}\b(?:désactivés?|requis|nécessaires?|activés?)",
    r"\b(?:aktivieren sie|schalten sie|erlauben sie|akzeptieren sie)\b[^.\n]{0,20}\b(?:java ?script|skripte|scripts|cookies)|\b(?:java ?script|cookies) (?:ist|sind|muss|müssen)\b[^.\n]{0,20}\b(?:deaktiviert|aktiviert|erforderlich|notwendig)|\bbenötigt (?:java ?script|cookies)",
    r"\b(?:active|habilite|permita|acepte|debe (?:activar|habilitar)|es necesario (?:activar|habilitar))\b[^.\n]{0,20}\b(?:java ?script|scripts|cookies)|\b(?:java ?script|cookies) (?:está|están|debe|deben)\b[^.\n]{0,20}\b(?:desactivad[oa]s?|habilitad[oa]s?|activad[oa]s?)|\bnecesita (?:java ?script|cookies)|\brequiere (?:java ?script|cookies)",
]
SCRIPTS += [
    rf"\b(?:turn|switch) {_TECH} (?:back )?on\b|^\W*{_TECH} (?:is |are )?(?:required|disabled|not enabled|not supported|blocked|turned off|switched off|needed)\W*$|\bnoscript\b",
    rf"\bbitte\b[^.\n]{{0,40}}\b(?:{_TECH}|skripte)\b[^.\n]{{0,30}}\b(?:aktivieren|einschalten|zulassen|erlauben|akzeptieren|freigeben)|^\W*{_TECH} (?:aktivieren|einschalten|zulassen|erlauben|akzeptieren)\b|\b(?:ihr|dein) browser\b[^.\n]{{0,50}}\b(?:{_TECH}|skripte)\b",
    rf"\bvotre navigateur\b[^.\n]{{0,60}}\b{_TECH}\b|\b(?:autorisez|acceptez|autoriser|accepter) (?:le |les )?(?:java ?script|scripts|cookies)|\b(?:nécessite|requiert|a besoin de|exige) (?:le |les |de |des |que )?(?:java ?script|scripts|cookies)",
    rf"\b(?:su|tu) navegador\b[^.\n]{{0,60}}\b{_TECH}\b|\b(?:activar|active|habilitar|permitir|aceptar|acepte) (?:el |los |las )?(?:java ?script|scripts|cookies)|\b(?:requiere|necesita|exige) (?:el |los |que )?(?:java ?script|scripts|cookies)",
]

#: Prose that reports a message or names a word: a speaker, a duty or a quotation around it, never the words of the hit itself.
#: The first kind also holds for placeholders, on both sides of the hit.
_NAMED = r"\b(?:the words|the word|the phrase|the (?:message|notice|string|text|form|field|sign|banner|page|screen) (?:said|says|read|reads|stating|saying|named|called|[“\"'‘])|says [“\"'‘]|said [“\"'‘]|reads [“\"'‘]|reading [“\"'‘]|marked [“\"'‘]|labell?ed [“\"'‘]|called [“\"'‘]|for example|e\.g\.|for instance|(?:the|a|this|that|its|their|in|with|template) (?:\p{L}+ ){0,2}syntax\b(?! error)|(?:the|a|this|our|in) (?:\p{L}+ )?tutorial\b|in this example|stands for|zum beispiel|z\.\s?B\.|par exemple|por ejemplo)"
_PASSIVE = r"(?<!\b(?:be|is|are|was|were|been|being|as|not) )"
_SPEECH = r"(?:told|tells|testif(?:y|ied|ies|ying)|argue[ds]|alleg(?:e|ed|es|ing)|complain(?:ed|s|ing)|stated|explain(?:ed|s)|wrote|writes|recall(?:ed|s))\b"
#: Before the hit, in the same sentence: someone says, owes or is shown it.
_BEFORE = rf"(?:(?<=[\p{{L}},)] ){_PASSIVE}{_SPEECH}|\b(?:was|were|been) told (?:that|the|of|it|by)\b|\b(?:claims|means) that\b|\bwitness(?:es)? (?:\p{{L}}+ ){{0,3}}?(?:said|saw|read|described|remembered)\b|(?<=[\p{{L}},)] )(?<!\b(?:you|users|visitors|readers) )(?:shall|warrants?|warranted)\b|{_PASSIVE}\b(?:displayed|showed|shown) (?:(?:him|her|them|me|us|only|just|visitors|users) )*(?:(?:an?|the|this|that|another|one)\b|[“\"'‘\d])|\b(?:was|were|been) shown (?:an?|the)\b|\breported an error|\bknown as\b|\bsuch as\b|\bstill carried\b|\b(?:the|a|his|her|their) (?:\p{{L}}+ )?screenplay\b|\bdijo que\b|\bdeclaró que\b|\p{{L}} erklärte\b|\ba déclaré\b)(?:(?![.!?…][”\"'’»]?\s)[^\n])*$"
#: After the hit, in the same sentence: who said it, to whom it was shown.
_AFTER = rf"^(?:(?![.!?…][”\"'’»]?(?:\s|$))[^\n])*?(?:(?<=[,”\"'’»] )(?:[\p{{L}}.]+ ){{1,4}}(?:said|says|{_SPEECH})|\b(?:was|were|is|are|had been|has been) (?:shown|displayed) (?:to|on|in|when|whenever|for|if|by)\b|\bis written (?:in|on|as|over|across|under)\b)"
#: Quotation marks; an apostrophe within a word is none.
_MARKS = r"[“”\"„‘’`«»]|(?<!\p{L})'|'(?!\p{L})"
_CODE = r"^\s*(?:```|~~~|def |class |return\b|import |from \S+ import|for \S+ in |while |if .*:\s*$|elif |else:|try:|except|print\(|var |let |const |function\b|#include|public |private |static |SELECT |INSERT |\$ |>>> |[\w.]+\s*[+\-*/]?=\s*\S+;?\s*$|[})\]];?\s*$)|=>|[;{]\s*$|\w+\([^)]*\)\s*[;{]|\{\w+:\s*\w+ for "

#: At most so many strings are kept as the hints of a pattern.
_MOST = 400


def _cost(hints: set[str]) -> float:
    """About how often one of the strings comes in a text. Short strings of letters are parts of many words."""
    return sum(max(prod(0.06 if c.isalnum() else 0.2 if c in " $%€" else 0.01 for c in h), 0.3 ** len(h) if h.replace(" ", "").isalnum() else 0) for h in hints)


def _cheapest(*sets: set[str] | None) -> set[str] | None:
    return min((x for x in sets if x and "" not in x), key=_cost, default=None)


def _required(items) -> tuple[set[str] | None, set[str] | None]:
    """Of a parsed pattern: all the strings it matches, if they are few, and strings of which each match holds one. Both in lower case."""
    run, exact, best = {""}, True, None
    for op, arg in items:
        op = str(op)
        again: set[str] | None = None  # what stands at the end of an open repetition
        if op == "LITERAL":
            every, some = {fold(chr(arg))}, None
        elif op in ("AT", "ASSERT", "ASSERT_NOT"):
            every, some = {""}, None
        elif op == "IN" and all(str(o) == "LITERAL" or str(o) == "RANGE" and x[1] - x[0] < 8 for o, x in arg):
            every, some = {fold(chr(c)) for o, x in arg for c in ([x] if str(o) == "LITERAL" else range(x[0], x[1] + 1))}, None
        elif op == "SUBPATTERN":
            every, some = _required(arg[3])
        elif op == "BRANCH":
            parts = [_required(x) for x in arg[1]]
            every = set().union(*(e for e, _ in parts)) if all(e is not None for e, _ in parts) else None
            of = [_cheapest(*x) for x in parts]
            some = set().union(*of) if all(of) else None
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            one, part = _required(inner)
            times = [{""}]
            while one and len(times) <= min(most, 4) and len(times[-1]) * len(one) <= _MOST:
                times.append({x + y for x in times[-1] for y in one})
            every = set().union(*times[least : most + 1]) if most < len(times) else None
            again = times[min(least, len(times) - 1)] if one else None
            some = _cheapest(part, again) if least else None
            again = again if least else None
        else:  # any character, a class, a back reference
            every, some = None, None
        if every is not None and len(run) * len(every) <= _MOST:
            run = {x + y for x in run for y in every}
            continue
        exact = False
        if again and len(run) * len(again) <= _MOST:
            best = _cheapest(best, {x + y for x in run for y in again})
        best = _cheapest(best, run, some, every)
        run = every or again or {""}
    return (run if exact else None), _cheapest(best, run)


def fold(text: str) -> str:
    """Lower case, character by character, also of those that a pattern equals to a Latin letter though they aren't its upper case."""
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def hints(pattern: str) -> set[str] | None:
    """Strings in lower case of which every match of the pattern holds one, by its own grammar; None if there are no such strings."""
    found = _cheapest(*_required(re._parser.parse(regex.sub(r"\\p\{\w+\}", r"\\w", pattern), re.I)))
    return found and {h for h in found if not any(x != h and x in h for x in found)}


def alternatives(pattern: str) -> list[str]:
    """A pattern's alternatives outside of all brackets."""
    out, depth, inside, k = [""], 0, False, 0
    while k < len(pattern):
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        depth += 0 if inside else (c == "(") - (c == ")")
        inside = c == "[" or inside and c != "]"
        if c == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += c
        k += len(c)
    return out


def quoted(before: str, marks: list[tuple[int, str]], most: int = 120) -> bool:
    """Whether a quotation is open at the end of a text, begun at most so many characters before it. marks: the text's quotation
    marks and their places. A straight one opens or closes by their number, a single one also by what stands beside it."""
    since: dict[str, int] = {}
    for k, c in marks:
        of = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "«": "«", "»": "«"}.get(c, c)
        word = k > 0 and before[k - 1].isalnum()
        if c in "”»" or c == "“" and of in since or c in "'’" and (of in since or word):
            if not (c in "'’" and word and before[k + 1 : k + 2].isalpha()):
                since.pop(of, None)
        elif c in '"`' and of in since:
            del since[of]
        elif c != "’":
            since[of] = k
    return any(len(before) - k <= most + 1 for k in since.values())


class Rules:
    """The rules behind one automaton, which finds all hints of a text in a single pass, however many rules there are. The hints
    follow from the rules' patterns, each alternative of a rule for itself; only sentences with a hint are tried."""

    def __init__(self):
        self.rules = []
        self.always, self.again = [], []
        words: dict[str, list[int]] = {}
        for kind, rules in (("placeholder", PLACEHOLDERS), ("filler", FILLER), ("message", MESSAGES), ("script", SCRIPTS)):
            for pattern in (x for r in rules for x in alternatives(r)):
                n = len(self.rules)
                self.rules.append((kind, regex.compile("(?im)" + pattern)))
                of = None if pattern in (REPEATED, SHORT_LOREM) else {w for w in LOREM if len(w) > 4} if pattern == LOREM_RUN else hints(pattern)
                if of is None:
                    (self.again if pattern == REPEATED else self.always).append(n)
                for h in of or ():
                    words.setdefault(h, []).append(n)
        self.found = ahocorasick.Automaton()
        for h, of in words.items():
            self.found.add_word(h, of)
        self.found.make_automaton()
        self.cut, self.code, self.marks = regex.compile(r"\n|(?<=[.!?…])[ \t\p{Z}]+(?=[^\p{Ll}\s,;:])"), regex.compile(_CODE), regex.compile(_MARKS)
        self.named, self.before, self.after = (regex.compile("(?i)" + x) for x in (_NAMED, _BEFORE, _AFTER))
        self.fence = regex.compile(r"(?ms)^[ \t>]*(?:(```)[^`\n]*|(~~~)[^\n]*)$.*?^[ \t>]*(?:\1|\2)|^[ \t>]*```[^`\n]*```")

    def counts(self, s: str, m: regex.Match, inside: bool) -> bool:
        """Whether a hit in a sentence is neither quoted nor reported."""
        before = s[: m.start()]
        return not quoted(before, [(x.start(), x.group()) for x in self.marks.finditer(s, 0, m.start())]) and not self.reported(before, s[m.end() :], inside)

    def reported(self, before: str, after: str, inside: bool) -> bool:
        """Whether the words around a hit report it; of a placeholder, whether they name it."""
        return bool(self.named.search(before) or self.named.search(after) or not inside and (self.before.search(before) or self.after.search(after)))

    def kinds(self, text: str, repeated: bool) -> list[str]:
        """`repeated`: whether the rule for repeated words needs to be tried."""
        at: dict[int, list[int]] = {}
        for end, of in self.found.iter(fold(text)):
            for n in of:
                at.setdefault(n, []).append(end)
        whole = [n for n in self.always + self.again * repeated if self.rules[n][1].search(text)]
        if not at and not whole:
            return []
        cuts = [m.span() for m in self.cut.finditer(text)]
        starts = [0, *(b for _, b in cuts)]
        seg = [text[a:b] for a, b in zip(starts, [*(a for a, _ in cuts), len(text)])]
        fenced = [m.span() for m in self.fence.finditer(text)] if "```" in text or "~~~" in text else []
        plain = [x for x, a in zip(seg, starts) if x.strip() and not any(b <= a < e for b, e in fenced)]
        out: list[str] = []
        for n in sorted({*at, *whole}):
            kind, pattern = self.rules[n]
            if kind in out:
                continue
            inside = kind == "placeholder"
            for k in sorted({bisect_right(starts, end) - 1 for end in at[n]}) if n in at else range(len(seg)):
                s = seg[k]
                if not (inside and (self.code.search(s) or any(b <= starts[k] < e for b, e in fenced))) and any(self.counts(s, m, inside) for m in pattern.finditer(s)):
                    if not (inside and 2 * sum(1 for x in plain if self.code.search(x)) > len(plain)):
                        out.append(kind)
                    break
        return out


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kinds): the documents that hold residue, with its kinds: 'placeholder', 'filler', 'message' or 'script'.

    Method: an automaton searches each text once for the rules' hints (strings that each match of a rule must hold); the
    lines and sentences with one are tried with grammars for each pair of delimiters and patterns for filler, messages and
    script notices. A hit is discounted where the words around it report or quote it; a placeholder also inside code
    (fences, statements) and in texts of which half or more is code. Texts pass in Arrow batches and never move. (As Spark
    expressions the same rules took five times the CPU: Java tries every alternative at every place.) Null and empty texts
    hold none; repeated rows give repeated rows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules()
        for b in batches:
            found = [(i, k) for i, (t, again) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) if (k := rules.kinds(t, again))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([k for _, k in found], pa.list_(pa.string()))], names=["k", "kinds"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(text).rlike("(?iu)" + REPEATED.replace(r"\s", r"\s\p{Z}\x0B\x1c-\x1f\x85")).alias("again")).filter(F.length("t") > 0)
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(search, f"k {kind}, kinds array<string>").withColumnRenamed("k", key)

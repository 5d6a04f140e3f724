"""Error, access, loading and script phrases, filler phrases and placeholder fields, by language."""

# Phrases of error pages, access and loading notices and demands for scripts, in lower case; a line that holds one counts.
NOTICES = """
please enable javascript
enable javascript to continue
enable javascript to run this app
turn on scripts in your browser
turn on javascript
javascript is required
javascript is disabled
javascript is not enabled
you need to enable javascript
requires javascript
too many requests
rate limit exceeded
slow down
something went wrong
please try again in a few minutes
please try again later
we'll be back soon
we’ll be back soon
is down for planned maintenance
down for maintenance
under maintenance
isn't available in your region
isn’t available in your region
is not available in your country
bad gateway
gateway timeout
gateway time-out
your session has expired
your session has timed out
checking your browser before
this takes about
a client-side exception
a server-side exception
internal error
internal server error
an unexpected error
traceback (most recent call last)
verify you are human
verify that you are human
are you a robot
access denied
you have been blocked
your request was blocked
you don't have permission to access
you don’t have permission to access
page not found
the requested url was not found
does not exist on this server
the page you are looking for
no results matched your search
no results found
try fewer words
service unavailable
service is temporarily unavailable
loading…
loading...
please wait while
connection timed out
web server is down
wartungsarbeiten
wir sind gleich zurück
zugriff verweigert
bitte aktivieren sie javascript
javascript ist deaktiviert
seite nicht gefunden
die angeforderte seite
existiert nicht auf diesem server
interner serverfehler
zu viele anfragen
bitte warten
wird geladen
acceso denegado
debes habilitar javascript
habilita javascript
activa javascript
página no encontrada
la dirección solicitada no existe
la página que buscas
error interno del servidor
demasiadas solicitudes
en mantenimiento
veuillez activer javascript
activez javascript
page introuvable
page non trouvée
accès refusé
erreur interne du serveur
la page demandée
trop de requêtes
en cours de maintenance
доступ запрещён
доступ запрещен
включите javascript
страница не найдена
вернитесь на главную
ошибка 404
внутренняя ошибка сервера
слишком много запросов
технические работы
访问过于频繁
请启用 javascript
请启用javascript
页面不存在
页面未找到
您访问的页面
访问被拒绝
服务器内部错误
系统维护
请稍候
javascriptを有効にして
ページが見つかりません
お探しのページ
アクセスが拒否されました
サーバー内部エラー
リクエストが多すぎます
メンテナンス中
しばらくお待ちください
"""

# Shapes of lines of error pages that are no phrases: a trace, an exception, a count of requests.
NOTICE_SHAPES = [
    r"^\s*file \"[^\"]+\", line \d+",
    r"^\s*\w*(?:error|exception)\b: ",
    r"^you have sent \d+ requests",
]

# Shapes of lines that belong to an error page but tell nothing alone: a status code, a server's name and version, a reference.
NEUTRAL_SHAPES = [r"^\W*\d{3}\W*$", r"^[\w-]+/\d+(?:\.\d+)*$", r"^(?:reference|request|ray|incident)(?: id)?\W+[\w-]+$"]

# Titles of such pages that are no notices of their own in a text; 0 stands for any number.
NOTICE_TITLES = """
attention required
one moment, please
just a moment
error 0 (server error)
0 not found
not found
forbidden
undefined
untitled
untitled document
"""

# Filler in place of a text, in lower case.
FILLERS = """
lorem ipsum dolor
[object object]
hier steht später ihr text
hier könnte ihr text stehen
此处填写正文内容
在此输入
ここに本文が入ります
ここにテキストを入力
aquí va el texto
texto de ejemplo
votre texte ici
texte d'exemple
здесь будет текст
пример текста
"""

# Shapes of whole lines of filler, in lower case, and what a text must hold for them to be tried.
FILLER_SHAPES = [r"^(?:your |the )?[\w ]{2,40} goes here\W*$", r"^insert [\w ]{2,40} here\W*$", r"^todo:? ", r"\bundefined\b.*\bnan\b|\bnan\b.*\bundefined\b", r"^(?:sample|placeholder|dummy) text\b"]
FILLER_CUES = ["goes here", "insert ", "todo", "undefined", "sample text", "placeholder text", "dummy text"]

# Words of Latin dummy text.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate
velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa qui officia deserunt mollit anim laborum"""

# Names of fields that a template fills with content.
FIELDS = """title site name author user page post article section summary body content headline byline date published company address email customer
order price product description first last list archive heading url image tag category count total end start block render unsubscribe variable"""

# Pattern of placeholders of template languages, mail systems, build scripts and message catalogues.
PLACEHOLDER = (
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|[$#]\{[^{}\n]{1,60}\}|(?:<|&lt;)%=?[^%\n]{1,60}%(?:>|&gt;)|%%[A-Z][A-Z_]{1,40}%%|%[A-Z][A-Z_]{2,40}%|__[A-Z][A-Z_]{1,40}__|@@[A-Z][A-Z_]{1,40}@@"
    r"|\*\|[A-Z:_]{2,40}\|\*|\[\[[a-z_ ]{2,40}\]\]|\[[A-Z][A-Za-z]+(?:[ -][A-Z][A-Za-z]*)+\]|\[[A-Z]{2,}(?:[-_][A-Z]{2,})+\]|\{\d\}|\{[a-z_]{2,20}\}|^[a-z]+(?:\.[a-z_]+)*\.[a-z]+_[a-z_]+$"
)

"""Labelled exemplars of residue, one a line: wording of servers, frameworks, browsers, page builders and writers' habits, in many languages.

Some of them were met in the development data, the others are common phrases.
They are labels, not rules: `residue.py` types their terms, weighs them by the
corpus and finds texts that contain, or mix, enough of them. A variant of a
phrase needs no line of its own where typed terms cover it.
"""

#: Label -> exemplars. Stock Latin is filler too; `talk` are texts about such things.
EXEMPLARS = {
    "latin": """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Curabitur pretium tincidunt lacus.
Nulla gravida orci a odio.
Nullam varius, turpis et commodo pharetra, est eros bibendum elit, nec luctus magna felis sollicitudin mauris.
Integer in mauris eu nibh euismod gravida.
Duis ac tellus et risus vulputate vehicula.
Donec lobortis risus a elit.
Etiam tempor.
Ut ullamcorper, ligula eu tempor congue, eros est euismod turpis, id tincidunt sapien risus a quam.
Maecenas fermentum consequat mi.
Donec fermentum.
Pellentesque malesuada nulla a mi.
Duis sapien sem, aliquet nec, commodo eget, consequat quis, neque.
Aliquam faucibus, elit ut dictum aliquet, felis nisl adipiscing sapien, sed malesuada diam lacus eget erat.
Cras mollis scelerisque nunc.
Nullam arcu.
Aliquam consequat.
Curabitur augue lorem, dapibus quis, laoreet et, pretium ac, nisi.
Aenean magna nisl, mollis quis, molestie eu, feugiat in, orci.
In hac habitasse platea dictumst.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet, ante.
Donec eu libero sit amet quam egestas semper.
Aenean ultricies mi vitae est.
Mauris placerat eleifend leo.
Quisque sit amet est et sapien ullamcorper pharetra.
Vivamus sagittis lacus vel augue laoreet rutrum faucibus dolor auctor.
Cum sociis natoque penatibus et magnis dis parturient montes, nascetur ridiculus mus.
Phasellus viverra nulla ut metus varius laoreet.
Fusce dapibus, tellus ac cursus commodo, tortor mauris condimentum nibh, ut fermentum massa justo sit amet risus.
Morbi leo risus, porta ac consectetur ac, vestibulum at eros.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat, sed diam voluptua.
At vero eos et accusam et justo duo dolores et ea rebum.
Stet clita kasd gubergren, no sea takimata sanctus est.
Praesent sapien massa, convallis a pellentesque nec, egestas non nisi.
Vivamus magna justo, lacinia eget consectetur sed, convallis at tellus.
Quisque velit nisi, pretium ut lacinia in, elementum id enim.
Curabitur aliquet quam id dui posuere blandit.
Nulla porttitor accumsan tincidunt.
Proin eget tortor risus.
Mauris blandit aliquet elit, eget tincidunt nibh pulvinar a.
Vestibulum ac diam sit amet quam vehicula elementum sed sit amet dui.
Cras ultricies ligula sed magna dictum porta.
Pellentesque in ipsum id orci porta dapibus.
Donec rutrum congue leo eget malesuada.
Sed porttitor lectus nibh.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.
""",
    "filler": """
Item one
Item two
Item three
List item
Caption text
Paragraph text
Bullet text here
Bullet point
Heading goes here
Title goes here
Subtitle goes here
Add your content
Add your text here
Your text here
Enter text here
Click to edit
Text goes here.
Content goes here.
Example heading.
Example text.
Sample text for the section body.
This is sample text.
This is a dummy paragraph.
This is a placeholder text.
Placeholder text, please replace.
Replace this text with your own.
Replace this with your own content.
Describe the feature in your own words.
Write two or three sentences about the module at this place.
Write a short description here.
The quick summary belongs here.
Your description will go here.
Your summary goes here.
Nothing to see yet.
Dummy text
Hier steht später der Text dieses Abschnitts.
Platzhaltertext, bitte ersetzen.
Beispieltext, bitte ersetzen.
Blindtext
Hier Text einfügen
Texte d'exemple à remplacer.
Insérez votre texte ici.
Texto de ejemplo, sustitúyalo.
Texto de ejemplo para reemplazar.
Escriba aquí su texto.
Aquí va el texto de esta sección.
此处为示例文字，请替换为正式内容。
请在此输入内容。
这里是占位文字。
ここに本文が入ります。
ダミーテキストです。
ここにテキストを入力してください。
サンプルテキストです。
Text einfügen
Dies ist ein Platzhalter.
Dies ist ein Blindtext, er wird noch ersetzt.
Hier entsteht der Text.
Texte à compléter.
Ceci est un texte d'exemple.
Texte factice.
Saisissez votre texte ici.
Texto de ejemplo.
Aquí irá el texto.
Aquí irá la descripción.
Este es un texto de relleno.
Introduzca su texto aquí.
Testo di esempio.
Inserisci qui il testo.
Testo segnaposto da sostituire.
Texto de exemplo.
Insira o texto aqui.
Voorbeeldtekst.
Vul hier uw tekst in.
Przykładowy tekst.
Wpisz tutaj tekst.
Здесь будет текст.
Введите текст.
Пример текста.
示例文字
占位文本，稍后替换。
这里填写内容
仮のテキストです。
サンプル文章
The quick brown fox jumps over the lazy dog.
Franz jagt im komplett verwahrlosten Taxi quer durch Bayern.
Portez ce vieux whisky au juge blond qui fume.
Hello world! This is your first post.
Just another site
This is an example page.
This is a text block, click to edit it.
Click here to add text
Double click to edit this text.
Enter a description here.
Insert text here
Write your text here
Put your text here
Type something here
Your title here
Lorem ipsum dolor sit amet
Your headline here
Your company slogan
Short description of the section goes here.
Lorem ipsum
""",
    "announcement": """
Coming soon.
Coming soon, stay tuned.
Stay tuned.
Content will be added here.
Content will follow shortly.
More content to follow.
We are still writing this page.
This page was left blank on purpose until the first release.
This page is intentionally left blank.
This page is under construction.
This section is under construction.
This section will be written later.
To be written.
Work in progress.
Le contenu de cette page sera ajouté plus tard.
Page en construction.
Contenu à venir.
Bientôt disponible.
Inhalt folgt in Kürze.
Diese Seite befindet sich im Aufbau.
Der Inhalt dieser Seite wird später ergänzt.
El contenido de esta página se añadirá más adelante.
El contenido se añadirá pronto.
Próximamente.
Página en construcción.
内容待补充。
敬请期待。
页面正在建设中。
内容即将上线。
準備中です。
近日公開予定です。
このページは現在作成中です。
内容は後日追加されます。
Page coming soon.
New version coming soon.
Our site is coming soon.
Check back later for updates.
Please check back soon.
More information will be available shortly.
Details will be announced later.
To be announced.
To be continued.
To be completed.
To be determined.
This article is not written yet.
This page has no content yet.
Documentation is in progress.
This page is being worked on.
Under construction.
Under development.
This section is under development.
This chapter will follow soon.
More information to come.
More details to come soon.
Here you will find more soon.
Más información en breve.
Plus d'informations prochainement.
Weitere Inhalte folgen.
Altre informazioni in arrivo.
Dieser Abschnitt folgt später.
Weitere Informationen folgen in Kürze.
Wird noch ergänzt.
In Bearbeitung.
Demnächst mehr.
Diese Seite ist in Arbeit.
Cette section sera complétée prochainement.
Site en construction.
Page en cours de construction.
En cours de rédaction.
À compléter.
Sitio en construcción.
Muy pronto.
Pendiente de redactar.
Esta sección se completará más adelante.
Pagina in costruzione.
Prossimamente.
Contenuto in arrivo.
Em breve.
Página em construção.
O conteúdo será adicionado em breve.
Binnenkort beschikbaar.
Deze pagina is in aanbouw.
Już wkrótce.
Strona w trakcie budowy.
Strona w przygotowaniu.
Скоро здесь появится информация.
Сайт находится в разработке.
Страница в разработке.
待补充
建设中
即将推出
公開準備中
工事中
""",
    "error": """
404 Not Found
403 Forbidden
401 Unauthorized
400 Bad Request
410 Gone
408 Request Timeout
429 Too Many Requests
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
503 Service Temporarily Unavailable
504 Gateway Timeout
nginx
{"error": {"code": 404, "message": "not found", "trace": "1a2b3c4d"}}
{"error": {"code": 403, "message": "forbidden", "trace": "1a2b3c4d"}}
{"error": {"code": 401, "message": "unauthorized", "trace": "1a2b3c4d"}}
{"error": {"code": 410, "message": "gone", "trace": "1a2b3c4d"}}
{"error": {"code": 429, "message": "too many requests", "trace": "1a2b3c4d"}}
{"error": {"code": 500, "message": "internal server error", "trace": "1a2b3c4d"}}
{"error": {"code": 502, "message": "bad gateway", "trace": "1a2b3c4d"}}
{"error": {"code": 503, "message": "service unavailable", "trace": "1a2b3c4d"}}
{"error": {"code": 504, "message": "gateway timeout", "trace": "1a2b3c4d"}}
error=token_expired id
error=login_required id
error=session_timeout id
error=access_denied id
Request id
Node
Ref
Reference
Error code
Trace id
The server could not answer your request.
The server encountered an internal error and was unable to complete your request.
The server is temporarily unable to service your request.
The proxy could not reach the service behind it (too many open requests).
The proxy could not reach the service behind it (connection timed out).
The proxy could not reach the service behind it (closed by peer).
The proxy could not reach the service behind it (connection refused).
Access denied.
You do not have permission to view this on this server.
You don't have permission to access this resource.
You are not authorized to view this page.
Your session has expired.
Your session has timed out.
Sign in again to continue.
Please log in to continue.
Please sign in to continue.
Your link has expired.
This link has expired or is no longer valid.
The page you are looking for was removed.
The page you are looking for has moved.
The page you are looking for cannot be displayed.
The page you are looking for does not exist.
The page you requested could not be found.
This page could not be found.
Page not found
We lost this page.
We can't find that page.
This page is having trouble.
This page isn't working.
Check the address or use the search.
Oops!
Something went wrong.
Sorry, something went wrong.
An error occurred while loading the page.
An unexpected error has occurred.
Try again in 5 minutes or go back to the start page.
Please try again later.
Rate limit exceeded for the API.
Retry after 30 s.
Too many requests, please slow down.
Database connection failed: timeout after 30 ms.
Error establishing a database connection
Please contact the administrator.
Unhandled exception while rendering
Application error: a client-side exception has occurred
TypeError: cannot read field of undefined
Cannot read properties of undefined
at Name (module.js:10)
Zugriff verweigert.
Ihnen fehlen die Rechte für diese Seite.
Sie haben keine Berechtigung, diese Seite anzuzeigen.
Der Dienst ist zurzeit nicht erreichbar, bitte später erneut versuchen.
Seite nicht gefunden.
Die angeforderte Seite wurde nicht gefunden.
Die angeforderte Adresse gibt es nicht (mehr).
Fehler 404
Interner Fehler, bitte versuchen Sie es später noch einmal.
Ihre Sitzung ist abgelaufen.
Bitte melden Sie sich erneut an.
Interner Serverfehler
Page introuvable.
Erreur 404 : l'adresse demandée n'existe pas.
Une erreur est survenue lors du chargement.
Référence
Accès refusé.
Vous n'avez pas l'autorisation d'accéder à cette page.
Votre session a expiré.
Veuillez vous reconnecter.
Service temporairement indisponible, veuillez réessayer plus tard.
Acceso denegado: no tiene permiso para abrir este recurso.
Página no encontrada.
La página que busca no existe.
Error 404: la dirección solicitada no existe.
Su sesión ha caducado.
Inicie sesión de nuevo.
El servicio no está disponible, inténtelo más tarde.
Se produjo un error al cargar la página.
Error interno del servidor.
Inténtelo de nuevo más tarde.
Código 500
Erreur interne du serveur.
Réessayez plus tard.
Code 500
访问被拒绝，您没有权限查看该页面。
页面不存在或已被删除。
错误代码
服务器内部错误，请稍后再试。
编号
会话已过期，请重新登录。
服务暂时不可用。
您访问的页面出错了。
サーバーが混み合っています。
時間をおいて再度お試しください。
お探しのページは見つかりませんでした。
エラー
アクセスが拒否されました。
このページを表示する権限がありません。
セッションの有効期限が切れました。再度ログインしてください。
サーバー内部エラーが発生しました。
The page could not be loaded.
The requested URL was not found on this server.
The requested resource does not exist or was moved.
The file you requested was not found.
We could not find what you are looking for.
Sorry, this page does not exist any more.
The address is wrong or the page was deleted.
You are not allowed to open this page.
You need permission to access this resource.
Access to this resource is forbidden.
Access to this page was blocked.
Your request was blocked by the security rules.
The service is unavailable at the moment.
The service is down for maintenance.
The website is down for maintenance, we will be back shortly.
The server is too busy.
The server returned an error.
The server did not respond in time.
The server took too long to answer.
The upstream server sent an invalid response.
The connection has timed out.
The connection was reset.
Connection refused
Unable to connect
Request timed out.
Request failed with status code 500
The request could not be processed.
Sorry, we have a problem.
An internal error has occurred.
A server error occurred, please reload the page.
Invalid token
The token has expired.
Session timeout, you were logged out.
You have been logged out because of inactivity.
You must be logged in to view this page.
Your account does not have access to this page.
This page has expired.
Method not allowed
Payload too large
Server at host Port 80
Die Seite existiert nicht oder wurde gelöscht.
Es ist ein interner Fehler aufgetreten.
Die Verbindung wurde unterbrochen.
Zeitüberschreitung der Anfrage
La page demandée n'a pas été trouvée.
Cette page n'existe pas ou a été supprimée.
Le serveur a rencontré une erreur.
Délai d'attente dépassé.
No se encontró la página solicitada.
La página fue eliminada o ha cambiado de dirección.
Ha ocurrido un error inesperado.
El servidor tardó demasiado en responder.
La pagina non esiste o è stata rimossa.
Accesso negato.
Si è verificato un errore, riprova più tardi.
La sessione è scaduta, effettua di nuovo l'accesso.
A página não existe ou foi removida.
Acesso negado.
Ocorreu um erro, tente novamente mais tarde.
A sua sessão expirou.
De pagina bestaat niet of is verwijderd.
Toegang geweigerd.
Er is een fout opgetreden, probeer het later opnieuw.
Uw sessie is verlopen.
Strona nie istnieje lub została usunięta.
Brak dostępu.
Wystąpił błąd, spróbuj ponownie później.
Sesja wygasła, zaloguj się ponownie.
Страница не существует или была удалена.
Запрашиваемая страница не найдена.
Доступ запрещён.
Произошла ошибка, попробуйте позже.
Сессия истекла, войдите снова.
Сервер временно недоступен.
您访问的页面不存在。
网页无法访问，请检查地址。
服务器错误，请重试。
没有访问权限。
登录已过期，请重新登录。
请求超时，请稍后再试。
ページが存在しないか、移動しました。
エラーが発生しました。しばらくしてから再度お試しください。
サーバーに接続できません。
アクセスする権限がありません。
""",
    "notice": """
Please enable JavaScript to view this page.
JavaScript is required to view this page.
JavaScript is disabled in your browser.
You need to enable JavaScript to run this app.
Please turn on JavaScript and reload the page.
Kindly activate scripting and reload.
Turn on active content to continue.
Turn on JavaScript in order to view this data.
Turn on JavaScript to see the page.
This page does not work without JavaScript.
This page requires JavaScript.
This page only runs with JavaScript.
This page needs JavaScript.
You have to allow JavaScript to continue.
You have to allow JavaScript and reload.
Switch on JavaScript before you open the page.
Please activate JavaScript in order to view this data.
Then try once more.
Ask your administrator if it is blocked.
Change the settings of your browser.
Enable scripts to continue.
This page needs scripts.
This app works best with JavaScript enabled.
Scripts are off.
Switch them on to load the page.
No scripting, no content: allow it for the page.
Your browser is not supported or has JavaScript turned off; the page cannot start.
Your browser is out of date.
Sorry, the page cannot be shown while JavaScript is switched off.
If nothing happens, JavaScript may be blocked for this page.
Checking your browser before opening the page...
Checking your connection before opening the page...
Checking if the site connection is secure
Verifying that you are human.
Please complete the security check to access the site.
This takes about 5 seconds.
This process is automatic, you will be redirected shortly.
JavaScript and cookies must be on.
Enable JavaScript and cookies to continue
Loading...
Loading please wait
Please wait
Diese Anwendung läuft nur mit eingeschaltetem JavaScript.
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.
Skripte sind in Ihrem Browser abgeschaltet.
Ohne sie bleibt die Seite leer.
Für diese Seite wird JavaScript benötigt.
Ihr Browser wird geprüft.
Veuillez activer JavaScript pour afficher ce contenu.
Cette application exige JavaScript.
Les scripts sont désactivés : la page ne peut pas s'ouvrir.
Vérification de votre navigateur.
Active JavaScript en su navegador para ver esta página.
Esta aplicación necesita scripts; permítalos y vuelva a cargar.
Los scripts están desactivados en su navegador.
Comprobando su navegador antes de acceder.
本应用需要脚本支持，请开启后刷新。
浏览器已禁用脚本，页面无法显示。
请启用 JavaScript 后继续浏览本页。
正在检查您的浏览器。
このページを表示するには JavaScript を有効にしてください。
スクリプトが無効のため、内容を表示できません。
ブラウザを確認しています。
Please allow scripts for this site in your browser.
This site does not work if scripts are turned off.
You must enable JavaScript in your browser to use this site.
Your browser does not support JavaScript.
JavaScript is required.
JavaScript seems to be disabled in your browser.
Without JavaScript the page cannot be shown correctly.
Your browser is too old, please update it.
Please turn off your ad blocker.
Cookies must be enabled.
Please wait while we check your browser.
Please wait while your request is being verified.
Checking that you are not a robot.
Confirm that you are human to continue.
Security check
One moment, please.
The page loads in a few seconds.
Protection against bots and attacks by the firewall.
Bitte schalten Sie JavaScript ein.
JavaScript ist in Ihrem Browser deaktiviert.
Ihr Browser unterstützt kein JavaScript.
Einen Moment, Ihre Verbindung wird geprüft.
JavaScript est désactivé dans votre navigateur.
Ce site nécessite JavaScript.
Un instant, vérification de la connexion.
JavaScript está desactivado.
Debe habilitar JavaScript para usar este sitio.
Este sitio requiere JavaScript.
JavaScript è disattivato nel browser.
Attiva JavaScript per vedere la pagina.
O JavaScript está desativado.
Habilite o JavaScript para usar este site.
JavaScript is uitgeschakeld in uw browser.
Schakel JavaScript in om deze pagina te bekijken.
Włącz JavaScript w przeglądarce.
Ta strona wymaga JavaScript.
Включите JavaScript в браузере.
Сайт требует JavaScript.
Проверка браузера
请在浏览器中启用脚本。
此页面需要 JavaScript。
正在验证，请稍候。
JavaScript が無効になっています。
ブラウザの設定でスクリプトを許可してください。
""",
    "navigation": """
Home | Docs | Search
Contact | Status
Contact | Imprint | Privacy
Back to start
Back to home
Home
Menu
Login | Sign up
Previous | Next
Skip to content
All rights reserved
v1.2
Privacy Policy
Terms of Service
Sign in
Register
Shop
Cart
Blog
FAQ
Help
About
Next
Back
Copyright
""",
    "slot": """
{{title}}
Hello {{name}},
Dear {{name}},
Regards, {{name}}
{owner}
# {owner}
TBD: {owner}
Hello {name}
Hi {name}
Dear {name}
Regards {name}
Title: {title}
Name: {name}
Owner: {owner}
Author: {author}
Written by {author}
Reviewer: {reviewer}
Reviewed by {reviewer}
Approved by {reviewer}
Maintainer: {owner}
Team: {team}
Contact: {email}
Email: {email}
Date: {date}
Due date: {date}
Deadline: {date}
Release date: {date}
Last updated: {date}
Version: {version}
Status: {status}
Priority: {priority}
License: {license}
Summary: {summary}
Description: {description}
Hi {name}, welcome
Signed {name}
From {name} to {name}
Subject: {subject}
Address: {address}
Phone: {phone}
Company: {company}
Department: {team}
Project: {name}
Language: {lang}
""",
    "talk": """
Sample text in the examples is now generated from real packages, and the placeholder check looks for the slot.
In the report template the slot is replaced before the file is written; the other works the same way.
We removed the lorem ipsum fixtures from the tests.
In Python, the names are read first; the format string stays.
This is the skeleton that is rendered for each package.
The page is what the crawler stored for these links, so it drops those by status.
The viewer needs JavaScript, the export does not; readers without scripts get the static file.
When the server answers with an error, it retries and then logs the id.
Users saw the text when it met a null owner; it now reports the missing field by name.
It raised an exception; the cause was a late snapshot.
The template variable is filled in by the build; an unknown placeholder is an error.
""",
}

"""Texts for judging `llm/residue.py` that no exemplar was taken from: messages of well-known servers, frameworks and browsers, page builders and mails.

They were written down before the exemplars were extended, and none of them, nor a sentence of one but "Access denied" and "Oops", is there or may be added.
"""

RESIDUE = {
    "error": [
        "The page you were looking for doesn't exist.\nYou may have mistyped the address or the page may have moved.", "We're sorry, but something went wrong.",
        "HTTP Error 404.0 - Not Found\nThe resource you are looking for has been removed, had its name changed, or is temporarily unavailable.",
        "Forbidden\n\nYou don't have permission to access /admin/ on this server.\n\nApache/2.4.41 (Ubuntu) Server at example.com Port 80",
        "This site can't be reached\nwww.example.com took too long to respond.\nERR_CONNECTION_TIMED_OUT", "Whoops, looks like something went wrong.",
        "Error 1020\nAccess denied\nThis website is using a security service to protect itself from online attacks.", "Web server is down\nError code 521",
        "Service Unavailable\nHTTP Error 503. The service is unavailable.", "Proxy Error\nThe proxy server received an invalid response from an upstream server.",
        "Your login session timed out due to inactivity. Log in once more.", "Bad gateway. The server returned an invalid or incomplete response.",
        "Pagina non trovata. La pagina richiesta non è disponibile.", "Erro 404. A página solicitada não foi encontrada.", "Страница не найдена. Возможно, она была удалена.",
        "Pagina niet gevonden. De opgevraagde pagina bestaat niet.", "Strona nie została znaleziona.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es in einigen Minuten erneut.",
        "Désolé, la page que vous recherchez n'existe plus.", "Lo sentimos, no hemos podido encontrar la página que buscas.", "申し訳ございません。お探しのページは削除されたか、URLが変更された可能性があります。",
        "抱歉，您要访问的页面不存在或已被移除。", "系统繁忙，请稍后重试。", "Home | Shop | Cart\n\nOops! That page can't be found.\n\nIt looks like nothing was found at this location.",
    ],
    "notice": [
        "For full functionality of this site it is necessary to enable JavaScript.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
        "JavaScript must be enabled in order for you to use this website in standard view.", "Just a moment...\nChecking if the connection is secure before proceeding.",
        "Please verify you are a human.\nAccess to this page has been denied because we believe you are using automation tools to browse the website.",
        "Per utilizzare questo sito è necessario abilitare JavaScript.", "Ative o JavaScript no seu navegador para continuar.", "Для работы сайта необходимо включить JavaScript.",
        "Um diese Website nutzen zu können, aktivieren Sie bitte JavaScript.", "Votre navigateur ne prend pas en charge JavaScript ou il est désactivé.", "本サイトの閲覧にはJavaScriptを有効にする必要があります。", "您的浏览器未启用JavaScript，请启用后重试。",
        "<noscript>You need to allow scripts to use this site.</noscript>",
    ],
    "announcement": ["Our new website is on its way. Check back soon!", "Strona w budowie. Zapraszamy wkrótce.", "Страница находится в разработке.", "Sito in costruzione.", "Details to follow.", "Diese Seite wird gerade überarbeitet.", "La page est en cours de rédaction."],
    "filler": [
        "Welcome to WordPress. This is your first post. Edit or delete it, then start writing!", "I am text block. Click edit button to change this text.", "Insert your text here. Insert your text here.",
        "Li Europan lingues es membres del sam familie. Lor separat existentie es un myth.", "Far far away, behind the word mountains, far from the countries Vokalia and Consonantia, there live the blind texts.",
        "qwerty qwerty asdf zxcv qwerty asdf", "Donec sollicitudin molestie malesuada. Vivamus suscipit tortor eget felis porttitor volutpat.", "Dies ist ein Typoblindtext.", "Voici un texte de remplissage.", "foo bar baz foo bar baz qux",
    ],
    "slot": [
        "Dear [First Name],\n\nthank you for your order.", "Hi {first_name}, welcome to the team.", "Copyright <YEAR> <COPYRIGHT HOLDER>", "Hello %FIRSTNAME%,", "Sehr geehrte(r) [Name],", "{{" + "a" * 61 + "}}",
        "Your order #{{order_id}} has shipped.", "[INSERT COMPANY LOGO]", "Cher {{ prenom }},", "Meeting on [Date] at [Time] in [Location].", "Subject: ${subject}", "Unclosed.\n\n```\ncode\n\nDear {{name}}", "Prepared by: [Your Full Name Here]",
    ],
}

CONTENT = [
    "The crawler returned 404 for three of the pages, so we removed the links from the index.", "When the page is not found, the router falls back to the search view and logs the path.",
    "Access to the store was denied in two runs because the token had expired; after a new login the build passed.", "JavaScript files are parsed first, then the TypeScript ones; both end in the same index.",
    "Enable JavaScript source maps in the bundler to see the original lines.", "We want to put lorem ipsum into the preview, because real texts are confidential.", "The placeholder {{name}} in the mail template is replaced by the customer's name before sending.",
    "Use `{{ title }}` in the layout and `<your-name>` in the example.", "```\nDear {{name}},\n```\n\nThis is how a greeting is written in the template.", "The error page of the old site said that the session had expired. We changed the wording last week.",
    "A 503 during the deploy is expected and lasts less than a minute; the balancer retries once.", "The page is coming soon in the release plan, together with the new parser and the two reports.", "La page introuvable est maintenant traitée par le routeur, qui renvoie vers la recherche.",
    "Die Seite wird nicht gefunden, wenn der Index älter ist als der letzte Lauf; deshalb bauen wir ihn täglich neu.", "Se produjo un error al leer el índice y lo corregimos en la versión 2.3.", "由于页面不存在的链接太多，我们重建了索引。", "ページが見つからない場合はインデックスを再構築します。",
    "Add your name to the list of reviewers and push the branch.", "Version: 2.3.1\nStatus: accepted\nDate: 2025-03-02\nOwner: core team", "See [the guide](docs/guide.md) and [1] for the order of the steps.", "for (const [name, value] of map) { out[name] = value; }",
    "foo() calls bar(), and bar() calls baz(), which reads the cache.", "The test tests that testing the tester works.", "Map<String, List<Integer>> counts = new HashMap<>();", "The list is sorted by size, then by name; ties keep the order of the input.",
    "Error handling was moved into the reader, which now retries twice and then reports the file.", "If scripts are blocked by policy, the export runs without them and writes a static file.", "We are still writing the parser; the renderer is done and its tests pass.",
    "404 of 503 files were parsed in the first run, the rest in the second.", "Ut is the abbreviation of the unit test folder, and dolor is its largest module.", "set -x; echo ${HOME} && ls $PATH", "| Name | Date | Status |\n|---|---|---|\n| parser | 2025-01-02 | done |",
    "El navegador no se usa aquí: los diagramas se escriben como archivos.", "We could not connect to the database in the first test because the port was taken, so the fixture now picks a free one.", "Please review the change and log in to the staging cluster to try it.",
    "Try again with a smaller batch; the server answered within 30 ms for 500 rows.", "The notice about cookies was moved to the footer and is now shown once per visitor.", "Items one to three of the agenda were closed; item four was moved to the next meeting.",
    "TBD items of the last review: none. All open questions were answered by the owners.", "Your branch is behind by 3 commits and can be fast-forwarded.",
]

# A second set, measured once before the vocabulary of concepts was widened, and again afterwards; the README has all figures.
FRESH = {
    "error": [
        "Not Found\n\nThe requested URL /index.php was not found on this server.", "Something broke on our end. Our team has been notified.", "Hmm. We're having trouble finding that site.", "Access to this resource on the server is denied!",
        "Sorry, you have been blocked\n\nYou are unable to access example.org", "An error occurred while processing your request.\n\nReference #18.2d351ab8.1557333295", "HTTP ERROR 500\n\nThis page isn't working right now.",
        "Your session is no longer valid. Please log in again.", "Link expired. Request a new one.", "Too many login attempts. Wait a few minutes before trying again.", "Das Dokument konnte nicht gefunden werden.", "Zugang verweigert. Bitte anmelden.",
        "Une erreur inattendue s'est produite. Veuillez réessayer.", "El enlace ha caducado o no es válido.", "Si è verificato un problema con il server.", "Página temporariamente indisponível.", "Сервер не отвечает. Повторите попытку позже.",
        "404，您访问的网页已删除。", "現在アクセスが集中しております。しばらくお待ちください。", "Internal error. Contact the administrator.",
    ],
    "notice": [
        "Please turn JavaScript on and reload the page.", "This website requires a browser with JavaScript support.", "Your browser has cookies disabled. Please enable cookies.", "Verifying you are human. This may take a few seconds.",
        "Bitte aktivieren Sie Cookies und JavaScript.", "Activez JavaScript puis rechargez la page.", "Necesita habilitar JavaScript para ver esta web.", "请开启JavaScript以正常浏览本站。", "JavaScriptをオンにしてください。",
    ],
    "announcement": ["This section is coming soon.", "Content coming soon!", "Page under development.", "Próximamente más información.", "More to come."],
    "filler": ["Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore.", "Your content goes here.", "This is placeholder text.", "test test test test test test", "Type your text here"],
    "slot": ["Hi {{ customer.name }},", "[Your Name]\n[Your Address]", "Dear %NAME%, thank you.", "Insert <your-company> here", "Name: {name}", "Total: ${amount} due on {{date}}"],
}
FRESH_CONTENT = [
    "The server was moved to a new rack and renamed on Monday.", "We log every request that was not found, with its path and the time.", "Access rights are checked once per session and kept for an hour.", "The browser tests need a server with scripts enabled; see the guide.",
    "Please check the links of the page before the release and report what is broken.", "An unexpected error in the reader stopped the run; a retry with a longer timeout passed.", "Coming soon was the title of the old page; it is gone now.", "The placeholder image has the size of the real one.",
    "La session est prolongée à chaque requête du navigateur.", "Der Server antwortet erst, wenn alle Dateien gelesen sind.", "服务器每天重启一次，日志保存三十天。", "Sample rates above one percent slow the tracer down.", "Text of the license is in the root folder.", "The name field is required, the title is optional.",
    "fix: reload page after login", "docs: describe how sessions expire", "Error codes are listed in the appendix.", "Enter the number of workers and press start; the run begins at once.",
]

# A third one, written after that and measured once: nothing was changed because of it.
LAST = {
    "error": [
        "Oh no! The page you tried to open is missing.", "Gateway timed out. Please refresh in a moment.", "We couldn't load this page.\nReload", "You need to be logged in to see this.", "Access to this file is restricted.",
        "The certificate of the server has expired.", "Unable to reach the server. Check your connection.", "Whoa! Too many requests. Slow down.", "Service is down for maintenance.", "Diese Adresse wurde nicht gefunden.", "Keine Berechtigung für diese Anwendung.",
        "Votre session a pris fin, reconnectez-vous.", "Le site est momentanément indisponible.", "No tiene acceso a esta página.", "Ha caducado la sesión.", "Accesso non autorizzato.", "Sessão expirada, entre novamente.", "Доступ к странице ограничен.",
        "Brak uprawnień do tej strony.", "该链接已失效。", "アクセスできません。権限を確認してください。",
    ],
    "notice": [
        "JavaScript is turned off in your web browser.", "Enable cookies and reload this page.", "We are checking your browser before you access the site.", "Scripts must be allowed to use this application.", "Ihr Browser blockiert JavaScript.",
        "Merci d'activer JavaScript.", "Active las cookies del navegador.", "JavaScript deve essere attivo nel browser.", "请允许浏览器运行脚本。",
    ],
    "announcement": ["Coming very soon.", "This page is still under construction.", "Kommt bald.", "Bald verfügbar.", "Contenido próximamente."],
    "filler": ["Placeholder text", "Add your own text here.", "Beispieltext.", "blah blah blah blah blah", "Lorem ipsum dolor sit amet consectetur"],
    "slot": ["Hallo {{ vorname }},", "Ticket: %TICKET%", "[Insert date here]", "Owner: TBD", "<Your Name>"],
}
LAST_CONTENT = [
    "We load the page index once and keep it in memory.", "The browser cache is cleared when a session ends.", "Requests without a token are answered with an error and logged.", "Cookies are not used by the viewer.", "If the connection is lost, the client tries again after two seconds.",
    "La página de errores ahora enlaza con la guía.", "Die Anmeldung läuft nach einer Stunde ab, danach wird das Token erneuert.", "Le serveur refuse les fichiers trop grands.", "链接检查每晚运行一次。", "The text of the notice was shortened.", "Retry the job with fewer files.", "fix: check session before redirect",
]

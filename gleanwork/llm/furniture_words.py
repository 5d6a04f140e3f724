"""Words of page furniture by language, as web pages commonly carry them; a weak vote beside the ratios."""

# Items of navigation bars, breadcrumbs and footers.
ITEMS = {
    "en": "Home, About, Contact, Docs, Blog, Community, Partners, Pricing, Status, Support, Downloads, API, Careers, Tutorials, Terms of use, Imprint, Privacy, Sitemap, Advertise, Accessibility, Help, Login, Log in, Sign in, Products, News, Forum",
    "de": "Startseite, Über uns, Kontakt, Aktuelles, Produkte, Preise, Hilfe, Forum, Karriere, Anmelden, Impressum, Datenschutz, Barrierefreiheit, AGB",
    "fr": "Accueil, Produits, Connexion, Tarifs, Aide, Actualités, Communauté, À propos, Mentions légales, Plan du site, Confidentialité, CGU",
    "es": "Inicio, Productos, Precios, Ayuda, Comunidad, Noticias, Quiénes somos, Iniciar sesión, Contacto, Privacidad, Condiciones, Aviso legal, Mapa del sitio",
    "ru": "Главная, Продукты, Новости, Цены, Форум, Войти, Помощь, О нас, Контакты, Условия, Конфиденциальность",
    "zh": "首页, 关于我们, 产品, 价格, 新闻, 社区, 登录, 帮助中心, 联系我们, 隐私政策, 使用条款, 网站地图",
    "ja": "ホーム, 会社概要, 製品, 料金, ニュース, コミュニティ, ログイン, ヘルプ, お問い合わせ, プライバシー, 利用規約, サイトマップ",
}

# First items of a breadcrumb.
HOMES = "Home, Startseite, Accueil, Inicio, Главная, 首页, ホーム"

# Headings above links to other pages.
SIDEBARS = {
    "en": "You may also like, Latest posts, Related articles, Popular this week, On this page, Related posts, Most read",
    "de": "Meistgelesen, Das könnte Sie auch interessieren, Ähnliche Beiträge",
    "fr": "À lire aussi, Articles similaires, Les plus lus",
    "es": "Lo más leído, Artículos relacionados, También te puede interesar",
    "ru": "Похожие статьи, Популярное, Читайте также",
    "zh": "热门推荐, 相关文章",
    "ja": "人気の記事, 関連記事",
}

# Patterns of prompts and notices, searched in a whole line that the ratios have found low.
SHAPES = [
    r"\bnewsletter\b",
    r"^(share (this|on|via)|tweet|pin it|follow us|subscribe|sign up|like us)\b|\bsign up$|\b(never|don't) miss a\b",
    r"^[©Ⓒ] ?\d{4}\b|^copyright (©|\d{4})|\ball rights reserved\b|^powered by ",
    r"\bcookies?\b.*\b(accept|agree|ok|policy|preferences|reject)\b",
    r"^(\d+ (likes?|shares?|comments?|views?)\W*)+$",
    r"\d+ captures?\b.*\babout this capture$",
    r"\b\d+ (readers|subscribers|followers|abonnés|lectores|suscriptores|leser|lesern)\b.{0,40}$|\d+ ?(читател|подписчик)|\d+(位读者|人が購読)",
    r"^was this (page|article) (helpful|useful)",
    r"\bcookies\b.*\b(einverstanden|akzeptieren|einstellungen)\b|alle rechte vorbehalten|^(beitrag|artikel) teilen$|^\d+ kommentare?$",
    r"\bcookies\b.*\b(accepter|refuser|paramétrer)\b|tous droits réservés|^partager\b.{0,30}$|^abonnez-vous\b|^\d+ commentaires?$",
    r"\bcookies\b.*\b(aceptar|rechazar|configurar)\b|todos los derechos reservados|^compartir\b.{0,30}$|^\d+ comentarios?$|\bboletín\b",
    r"\bcookie\b.*\b(принять|настроить)\b|все права защищены|^поделиться\b.{0,20}$|^комментари\w+:? \d+$|подписаться на рассылку",
    r"cookie.*(接受|设置)|版权所有|^分享到|^评论.{0,3}\d+|订阅",
    r"(クッキー|cookie).*(許可|同意|設定)|無断転載|^この.{0,4}を共有|^コメント ?\d+|メールマガジン|購読中",
]

# What a line must hold, in lower case, for one of the patterns to match; saves trying them on the others.
CUES = """newsletter, share, tweet, pin it, follow, subscribe, sign up, like, comment, view, miss a, ©, ⓒ, copyright, rights reserved, powered by, cookie, capture, was this, readers, abonn, lectores, suscriptores, leser,
читател, подписчик, 位读者, 人が購読, vorbehalten, teilen, kommentar, droits, partager, derechos, compartir, comentario, boletín, права, поделиться, комментари, рассылку, 版权所有, 分享到, 评论, 订阅, クッキー, 無断転載, を共有, コメント, メールマガジン, 購読中"""

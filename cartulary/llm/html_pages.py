"""Pages made by rule, with known main text: the training sample of the HTML extractor. All words are invented."""

from __future__ import annotations

import random


def _words(r: random.Random, n: int) -> str:
    noisy = r.random() < 0.15
    out = []
    for i in range(n):
        w = "".join(r.choice(("ka", "lo", "mi", "re", "su", "te", "no", "va", "zi", "po", "an", "er")) for _ in range(r.randint(1, 4)))
        if noisy:
            w += r.choice(("***", "%%%", "&amp;&amp;", "###", " |"))
        out.append(w + (r.choice(",.") if r.random() < 0.12 else ""))
    return (" ".join(out).capitalize() + ("." if n > 3 and not noisy else "")) or "Ka"


def _size(r: random.Random) -> int:
    return int(2 ** r.uniform(0, 8))


#: Names of parts in other languages, by the first of their English names.
FOREIGN = {
    "nav": "navegacion navegación menue menü hauptmenue menú barre-nav", "header": "cabecera kopf kopfbereich entete en-tête encabezado", "footer": "pie pie-de-pagina fuss fusszeile fußzeile pied pied-de-page", "sidebar": "lateral barra-lateral seitenleiste randspalte colonne barre-laterale",
    "ad": "publicidad anuncio anuncios werbung anzeige publicite publicité", "cookie-notice": "aviso avisos hinweis avis boletin rundbrief", "search": "buscar busqueda suche recherche formulario", "comments": "comentarios kommentare leserkommentare commentaires opiniones", "share": "compartir teilen partager redes",
}


def _tag(r: random.Random, semantic: str, names: str) -> tuple[str, str]:
    """Opening and closing tag of a part: a semantic element, or a box with telling tokens (in some pages of another language, or without a meaning), or both."""
    way = r.random()
    name = r.choice(names.split())
    if r.random() < 0.2:
        name = r.choice(FOREIGN.get(names.split()[0], name).split())
    elif r.random() < 0.05:
        name = "x" + _words(r, 1).lower()
    attr = f' {r.choice(("class", "id"))}="{r.choice(("", "c-", "site-", "js-"))}{name}{r.choice(("", " wide", "-box"))}"' if way > 0.35 or not semantic else ""
    tag = semantic if semantic and way < 0.75 else r.choice(("div", "section", "div"))
    return f"<{tag}{attr}>", f"</{tag}>"


def _links(r: random.Random, n: int, box: bool = True) -> str:
    items = [f'<a href="/{_words(r, 1)}">{_words(r, r.randint(1, 5))}</a>' for _ in range(n)]
    if not box:
        return r.choice((" ", " | ", "<br>")).join(items)
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"


def _prose(r: random.Random) -> str:
    return r.choice(("{}", "<p>{}</p>", "<p>{}</p>", "<h3>{}</h3>", "<div>{}</div>")).format(_words(r, _size(r) // 2 + 1))


def _boilerplate(r: random.Random) -> dict[str, str]:
    def part(semantic: str, names: str, inner: str) -> str:
        a, b = _tag(r, semantic, names)
        return a + inner + b

    form = '<form action="/go">' + r.choice(("", f"<label>{_words(r, 2)}</label>")) + '<input name="q"><button>' + _words(r, 1) + f"</button>{r.choice(('', f'<p>{_words(r, 6)}</p>'))}</form>"
    comments = "".join(f'<div class="{r.choice(("comment", "reply", "item"))}"><b>{_words(r, 2)}</b><p>{_words(r, _size(r) // 2 + 1)}</p></div>' for _ in range(r.randint(1, 5)))
    return {
        "nav": part("nav", "nav menu navbar breadcrumbs", _links(r, r.randint(2, 12), r.random() < 0.75)),
        "header": part("header", "header masthead banner top", r.choice((f"<h1>{_words(r, 2)}</h1>", f"<p>{_words(r, 4)}</p>", f"<div>{_words(r, 3)}</div>")) + r.choice(("", _links(r, 3), form))),
        "footer": part("footer", "footer foot bottom copyright", r.choice(("&copy; ", "")) + _prose(r) + r.choice(("", _links(r, 4)))),
        "side": part("aside", "sidebar side widget related rail", f"<h3>{_words(r, 2)}</h3>" + r.choice((_links(r, 5), _prose(r), _prose(r) + _prose(r)))),
        "ad": part("", "ad ads advert sponsored promo advertisement", _prose(r)),
        "notice": part("", "cookie-notice consent popup newsletter alert notice", _prose(r) + r.choice(("", "<button>OK</button>", form))),
        "form": r.choice((form, part("", "search login subscribe contact-form", form))),
        "comments": part("section", "comments reader-comments discussion responses replies respond", f"<h3>{_words(r, 2)}</h3>" + comments + r.choice(("", form))),
        "share": part("", "share social follow", _links(r, 3, r.random() < 0.5)),
    }


def _article(r: random.Random) -> str:
    m = " data-main"
    blocks = []
    boxes = r.random() < 0.25  # plain boxes instead of paragraphs
    if r.random() < 0.2:  # a short page: one paragraph, or a heading and a few
        blocks = [f"<h1{m}>{_words(r, r.randint(1, 8))}</h1>"] * r.choice((0, 1, 1))
        if boxes:
            blocks = [x.replace("h1", "div") for x in blocks]
        for _ in range(r.choice((1, 1, 2, 3))):
            t = "div" if boxes else "p"
            blocks.append(f"<{t}{m}>{_words(r, _size(r) // 2 + 3)}</{t}>")
        return blocks
    if r.random() < 0.85:
        h = "div" if boxes else r.choice(("h1", "h1", "h2"))
        blocks.append(f"<{h}{m}>{_words(r, r.randint(1, 10))}</{h}>")
    for _ in range(int(2 ** r.uniform(0, 5))):
        kind = r.random()
        if kind < 0.7:
            inner = _words(r, _size(r))
            if r.random() < 0.2:
                inner += f' <a href="/x">{_words(r, 2)}</a> ' + _words(r, 4)
            if r.random() < 0.1:
                inner += f' <span class="hl"{m}>{_words(r, 3)}</span>'
            blocks.append(f"<div{m}>{inner}</div>" if boxes else f"<p{m}>{inner}</p>" if r.random() < 0.9 else f"<p{m}><b>{inner}<br>")
        elif kind < 0.78:
            blocks.append(f"<{(h := r.choice(('h2', 'h3')))}{m}>{_words(r, 4)}</{h}>")
        elif kind < 0.86:
            blocks.append(f"<ul{m}>" + "".join(f"<li{m}>{_words(r, r.randint(2, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.9:
            blocks.append(f"<blockquote{m}>{_words(r, _size(r))}</blockquote>")
        elif kind < 0.94:
            blocks.append(f"<table{m}><tr{m}><td{m}>{_words(r, 3)}</td><td{m}>{_words(r, 2)}</td></tr></table>")
        else:
            blocks.append(f"<div{m}>{_words(r, _size(r))}</div>")
    return blocks


def page(r: random.Random) -> str:
    bad = _boilerplate(r)
    pick = lambda *names: [bad[x] for x in names if r.random() < 0.5]
    blocks = _article(r)
    few = len(blocks) < 5
    for extra in pick("ad", "share", "form") if r.random() < 0.3 else []:
        blocks.insert(r.randint(1, len(blocks)), extra)
    if r.random() < 0.15:
        blocks += [bad["comments"]]
        bad["comments"] = ""
    way = 1 if few and r.random() < 0.7 else r.random()
    telling = ("article", "post", "entry-content", "content", "story", "main-text")
    foreign = ("contenido", "articulo", "artículo", "noticia", "cuerpo", "inhalt", "artikel", "beitrag", "contenu", "texte")
    attr = f' class="{r.choice(telling) if r.random() < 0.6 else r.choice(foreign) if r.random() < 0.6 else "x" + _words(r, 1).lower()}"'
    a, b = ("<article>", "</article>") if way < 0.55 else (f"<article{attr}>", "</article>") if way < 0.65 else (f"<div{attr}>", "</div>") if way < 0.85 else ("<main>", "</main>") if way < 0.9 else ("<div>", "</div>") if way < 0.91 else ("", "")
    main = a + "".join(blocks) + (b if r.random() < 0.95 or not a else "")
    if r.random() < 0.25:
        main = f'<div class="{r.choice(("wrap", "container", "row", "page"))}">{main}' + "".join(pick("side", "comments", "share")) + "</div>"
    first, last = pick("notice", "header", "nav", "ad", "form"), pick("share", "comments", "side", "ad", "footer", "notice")
    r.shuffle(first)
    head = f"<head><meta charset=utf-8><title>{_words(r, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    if r.random() < (0.4 if few else 0.12):  # a page with little or nothing around its text
        first, last = first[:1] * r.randint(0, 1), last[:1] * r.randint(0, 1)
    body = "".join(first) + main + "".join(last)
    way = r.random()
    before = "" if way < 0.1 else "<body>" if way < 0.2 else "<!DOCTYPE html><html>" + head + "<body>"
    return before + body + ("</body></html>" if before and r.random() < 0.9 else "")


def labelled(pages: int, seed: int) -> list[tuple[str, None]]:
    """Pages whose main elements carry the attribute data-main, which is no feature."""
    r = random.Random(seed)
    return [(page(r), None) for _ in range(pages)]

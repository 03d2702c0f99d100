"""Training of the page model: python -m postmill.llm.train_pages JOBS.parquet [PAGES].

The labelled pages are a bounded sample (PAGES, 6500 by default) of a jobs table; the labels come
from the phrases below, which people marked as furniture, and from where such lines stand. The model
then learns words, shapes and neighbourhoods, and holds beyond the phrases.
"""

from __future__ import annotations

import os
import re
import sys

import numpy as np

from postmill.llm.pages import EDGES, HEADING, MENU, SENTENCE, SHORT, SIZE, WEIGHTS, Reader, Tree, _h, shape, squash, sum_product

# Items of menus and footers, by language.
ITEMS = {
    "en": "contact|vacancies|publications|cookie settings|press room|faq|working here|terms of use|imprint|events|accessibility|search|where we are|home|privacy policy|complaints|get involved|partners|meet the team|all rights reserved|whistleblower channel|about us|log in|sitemap|☰|menu|news and stories|our work|donate",
    "de": "kontakt|stellenangebote|presse|impressum|standorte|mitmachen|veröffentlichungen|hinweisgeber|unsere arbeit|anmelden|cookie-einstellungen|das team|veranstaltungen|inhaltsverzeichnis|arbeiten bei uns|nutzungsbedingungen|datenschutz|barrierefreiheit|aktuelles|häufige fragen|partner|suche|alle rechte vorbehalten|über uns|spenden|startseite|beschwerden",
    "fr": "nos pays|faire un don|agenda|conditions d'utilisation|accessibilité|actualités|agir|offres d'emploi|confidentialité|nous écrire|partenaires|tous droits réservés|questions fréquentes|l'équipe|travailler ici|rechercher|accueil|plan du site|mentions légales|réglages des cookies|connexion|notre action|qui sommes-nous|presse|publications|réclamations|lanceurs d'alerte",
    "sv": "lediga jobb|kalender|vad vi gör|hem|tillgänglighet|ge en gåva|webbkarta|personuppgifter|logga in|kakinställningar|var vi finns|visselblåsning|rapporter|alla rättigheter förbehållna|användarvillkor|vanliga frågor|kontakta oss|engagera dig|nyheter|samarbeten|jobba här|om oss|medarbetare|pressrum|sök|klagomål",
    "da": "ledige stillinger|sideoversigt|kontakt os|tilgængelighed|brugsvilkår|medarbejdere|whistleblowerordning|om os|forside|søg|persondata|ofte stillede spørgsmål|det gør vi|arbejd hos os|samarbejder|log ind|udgivelser|cookieindstillinger|alle rettigheder forbeholdes|bliv frivillig|støt os|nyheder|her er vi|klager",
    "es": "empleo|iniciar sesión|condiciones de uso|privacidad|donar|alianzas|preguntas frecuentes|el equipo|todos los derechos reservados|qué hacemos|publicaciones|quiénes somos|accesibilidad|contáctanos|noticias|dónde estamos|aviso legal|ajustes de cookies|prensa|mapa del sitio|participa|inicio|trabaja aquí|buscar|quejas|canal de denuncias",
}
# Buttons, sign-ups and headings of other lists, by language.
BUTTONS = {
    "en": "copy link|share this job|manage preferences|save my choices|report this listing|only necessary|email to a friend|apply now|ok, got it|reject all|print this page|create an alert for this search|accept all|back to results|save job|sign up for job alerts|follow us|get new vacancies by e-mail every week|enter your e-mail address and press subscribe",
    "de": "alle ablehnen|folgen sie uns|auswahl speichern|nur notwendige|e-mail-adresse eingeben und abonnieren|stelle merken|seite drucken|neue stellen jede woche im postfach|weiterleiten|jobs per e-mail erhalten|suchauftrag anlegen|stelle teilen|jetzt bewerben|einstellungen verwalten|alle annehmen|zurück zur liste|anzeige melden|link kopieren",
    "fr": "nécessaires seulement|gérer mes choix|tout refuser|envoyer à un ami|suivez-nous|créer une alerte|garder l'offre|enregistrer|copier le lien|signaler l'annonce|postuler|tout accepter|les nouveaux postes chaque semaine|imprimer la page|retour à la liste|partager cette offre|enregistrer mes choix|recevoir les offres par courriel|saisissez votre adresse et validez",
    "sv": "bara nödvändiga|neka alla|hantera val|dela jobbet|ansök nu|få jobb via e-post|fyll i din e-postadress och prenumerera|följ oss|spara mina val|tillbaka till listan|godkänn alla|nya tjänster varje vecka|skriv ut sidan|spara annonsen|tipsa en vän|anmäl annonsen|kopiera länk|skapa bevakning",
    "da": "styr valg|følg os|accepter alle|kopier link|kun nødvendige|send til en ven|få job på mail|udskriv siden|gem mine valg|del jobbet|opret jobagent|anmeld opslaget|skriv din mailadresse og tilmeld dig|afvis alle|gem opslaget|nye stillinger hver uge|ansøg nu|søg stillingen nu|tilbage til listen",
    "es": "gestionar opciones|inscribirme ahora|rechazar todo|solo necesarias|síguenos|escribe tu correo y suscríbete|guardar oferta|enviar a un amigo|recibe ofertas por correo|copiar enlace|crear alerta|volver a la lista|guardar|denunciar anuncio|nuevos puestos cada semana|imprimir página|aceptar todo|compartir oferta|guardar mis opciones",
}
LISTS = re.compile(
    r"^(?:other jobs you may like|people also looked at|recently viewed|similar vacancies|more openings at|weitere angebote für sie|mehr offene stellen bei|zuletzt angesehen|ähnliche stellen|andere sahen sich auch an"
    r"|autres postes pour vous|d'autres offres chez|vus récemment|offres similaires|offres semblables|liknande jobb|fler lediga jobb hos|fler tjänster för dig|senast visade|andra tittade (?:också )?på|senest viste|flere stillinger til dig|flere ledige stillinger hos|lignende"
    r"|autres offres|otros puestos para ti|más ofertas en|vistos hace poco|ofertas parecidas|otras personas|d'autres ont|andre så også)",
)
NOTICE = re.compile(
    r"cookie|kakor|small files|kleine dateien|petits fichiers|små filer|pequeños archivos|javascript (?:is switched off|ist abgeschaltet|är avstängt|er slået fra|est désactivé|está apagado)|privacy matters|schutz ihrer daten|vie privée|integritet är viktig|privatliv er vigtigt|privacidad nos importa"
    r"|better experience|measure traffic|get a better|besseres erlebnis|zugriffe zu messen|mesurer la fréquentation|améliorer votre visite|bättre upplevelse|mäta trafik|bedre oplevelse|måle trafik|mejorar tu visita|medir"
    r"|change your choice|privacy notice|by continuing|in line with our|enligt vår policy|gemäß unserer richtlinie|selon notre politique|efter vores politik|según nuestra política|auswahl jederzeit|datenschutzerklärung|mit der nutzung"
    r"|changer d'avis|modifier votre choix|notice de confidentialité|en poursuivant|ändra ditt val|sidan om personuppgifter|genom att fortsätta|ændre dit valg|ved at fortsætte|siden om persondata|cambiar tu elección|aviso de privacidad|al continuar"
    r"|some of them are optional|davon sind freiwillig|certains sont facultatifs|några av dem är frivilliga|nogle af dem er frivillige|algunas son opcionales"
)
AGE = re.compile(r"(?:posted|veröffentlicht|publié|publicerad|slået op|publicado)\b.*\d|\d+ (?:days|tagen|jours|dagar|dage|días) (?:ago|veröffentlicht|sedan|siden)")
FOOT = re.compile(r"^(?:©|\(c\)|copyright\b)|^via \w+|^powered by|, 9(?:–9)?$|^\w+ 9, \S|^\w+(?:ats|hire|boards|jobs|careers)$|^(?:en|de|fr|sv|da|es)(?: [|/] (?:en|de|fr|sv|da|es))+$|^\w+ (?:tv|blog|shop|stories|academy|recruit|9)$")
# The headings of vacancies, by language.
HEADINGS = {
    "en": "what we offer|the role|background|how to apply|what you will do|your profile|contact",
    "de": "das bieten wir|die stelle|ihr profil|so bewerben sie sich|hintergrund|ihre aufgaben|kontakt",
    "fr": "ce que nous offrons|le poste|vos missions|votre profil|comment postuler|contexte|contact",
    "sv": "vi erbjuder|tjänsten|din bakgrund|bakgrund|det här ska du göra|så söker du|kontakt",
    "da": "vi tilbyder|stillingen|det skal du lave|baggrund|din baggrund|sådan søger du|kontakt",
    "es": "qué ofrecemos|el puesto|tu perfil|contexto|contacto|qué harás|cómo presentarse",
}
ITEM = {x for v in ITEMS.values() for x in v.split("|")}
BUTTON = {x for v in BUTTONS.values() for x in v.split("|")}
HEAD = {x for v in HEADINGS.values() for x in v.split("|")}
_PARTS = re.compile(r"\s*[|·•\t»«›]\s*|\s{3,}|\s+(?:::|[>/])\s+|\s{2,}")


def bare(p: str) -> str:
    return squash(re.sub(r"\(\d+\)", "", p)).strip(" []+»›«·→>!|:/*-–•<←")


def labels(text: str) -> list[int]:
    """1 for furniture, 0 for content, for each non-blank line."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    out: list[int] = []
    doubtful: list[int] = []
    inside = False
    for i, s in enumerate(lines):
        low, kind = squash(s), shape(s)
        parts = [bare(p) for p in _PARTS.split(s)]
        parts = [p for p in parts if p]
        known = [p in ITEM or p in BUTTON or bool(FOOT.search(p)) for p in parts]
        if low.rstrip(":").strip() in HEAD:
            inside = False
            if low.rstrip(":") in ITEM and low[-1] != ":":
                doubtful.append(i)
            out.append(0)
        elif LISTS.search(bare(s)):
            inside = True
            out.append(1)
        elif NOTICE.search(low):
            out.append(1)
        elif known and (all(known) or sum(known) >= 0.5 * len(known) and (len(known) > 2 or kind == MENU)):
            inside = inside and parts[0] not in ITEM
            out.append(1)
        elif len(parts) >= 2 and any(p in ("vacancies", "stellenangebote", "offres d'emploi", "lediga jobb", "ledige stillinger", "empleo") for p in parts[:3]):
            out.append(1)
        elif FOOT.search(low) or AGE.search(low) and len(low) < 90:
            out.append(1)
        elif inside and not (kind == SENTENCE or s[-1] in ".?" and s.count(" ") > 5 or kind == HEADING):
            out.append(1)
        else:
            inside = False
            out.append(0)
    for i in doubtful:
        # "Contact" is an item beside items and a heading above text.
        before = out[i - 1] if i else 1
        after = lines[i + 1] if i + 1 < len(lines) else ""
        out[i] = int(bool(before) and not (after and shape(after) == SENTENCE and not NOTICE.search(squash(after))))
        if not after and before:
            out[i] = 1
    for i in range(1, len(lines)):
        # A name among the items of a menu is an item, such as the board's own.
        if not out[i] and squash(lines[i]).rstrip(":") not in HEAD and shape(lines[i]) == SHORT and out[i - 1] and (i + 1 == len(lines) or out[i + 1] or bare(lines[i - 1]) in ITEM):
            out[i] = 1
    return out


def train(texts: list[str], titles: list[str | None], *, epochs: int = 8, rate: float = 0.05, batch: int = 128, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and potentials of the edges by the gradient of the log-likelihood (Adam)."""
    reader, pages = Reader(), []
    for t, name in zip(texts, titles):
        _, kinds, own, place = reader.lines(t, name)
        if kinds:
            pages.append((kinds, [(own_, place_) for own_, place_ in zip(own, place)], labels(t)))
    rng = np.random.default_rng(seed)
    w, pair = np.zeros(SIZE), np.zeros((EDGES, 2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    step = 0
    for epoch in range(epochs):
        loss = lines = 0.0
        order = rng.permutation(len(pages))
        for at in range(0, len(order), batch):
            tree, feats, gold = Tree(), [], []
            for j in order[at : at + batch]:
                kinds, f, y = pages[j]
                tree.page(kinds, len(feats))
                # Now and then a line's exact text and the exact lines around it are hidden, so that words and shapes learn to do without.
                for (own, place), u in zip(f, rng.random(len(f))):
                    feats.append([_h(x) for x in (own[int(u < 0.4) :] + (place[2:] if u < 0.25 else place))])
                gold += y
            parent, depth, edge, line = tree.arrays()
            where = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
            flat = np.concatenate([np.array(f) for f in feats])
            score = np.bincount(where, weights=w[flat], minlength=len(feats))
            unary = np.zeros((len(parent), 2))
            is_line = line >= 0
            unary[is_line, 1] = score[line[is_line]]
            y = np.array(gold)
            # Blocks are not labelled: their expectation is taken with the lines held to their labels.
            held = np.zeros_like(unary)
            held[is_line] = -1e4
            held[np.nonzero(is_line)[0], y[line[is_line]]] = unary[np.nonzero(is_line)[0], y[line[is_line]]]
            m1, b1, z1 = sum_product(parent, depth, edge, unary, pair)
            m0, b0, z0 = sum_product(parent, depth, edge, held, pair)
            loss += z1 - z0
            lines += len(y)
            g_line = np.zeros(len(feats))
            g_line[line[is_line]] = m1[is_line, 1] - m0[is_line, 1]
            gw = np.bincount(flat, weights=g_line[where], minlength=SIZE) / batch + 1e-5 * w
            gp = np.zeros_like(pair)
            real = parent >= 0
            np.add.at(gp, edge[real], (b1 - b0)[real])
            gp = gp / batch + 1e-3 * pair
            step += 1
            for x, g, m, v in ((w, gw, state[0], state[1]), (pair, gp, state[2], state[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        print(f"epoch {epoch}: loss a line {loss / max(lines, 1):.4f}", flush=True)
    return w, pair


def main(path: str, most: int = 6500) -> None:
    import pyarrow.parquet as pq

    t = pq.read_table(path, columns=["description_text", "title"]).to_pydict()
    rows = [(x, n) for x, n in zip(t["description_text"], t["title"]) if x and x.strip()][: most + 1000]
    rest = rows[most:]
    w, pair = train([x for x, _ in rows[:most]], [n for _, n in rows[:most]])
    np.savez_compressed(WEIGHTS + ".new.npz", weights=w.astype(np.float16), pair=pair.astype(np.float32))
    os.replace(WEIGHTS + ".new.npz", WEIGHTS)
    from postmill.llm.pages import furniture, load

    found = furniture(load(), [x for x, _ in rest], [n for _, n in rest])
    pairs = [(int(p >= 0.5), y) for page, (x, _) in zip(found, rest) for (_, p), y in zip(page, labels(x))]
    print("held-out lines", len(pairs), "agreement", sum(a == b for a, b in pairs) / max(1, len(pairs)))


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))

"""A small tree of HTML elements on the standard parser, for readers that go by structure."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without an end tag, and those that a new one of these kinds closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {"p": frozenset("p div ul ol li table h1 h2 h3 h4 h5 h6 section".split()), "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}


class Node:
    """An element: tag, attributes, and children, which are elements or texts."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in the order of the page."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def all(self, tag: str | None = None, test: Callable[[Node], bool] = lambda n: True) -> list[Node]:
        return [n for n in self.walk() if (tag is None or n.tag == tag) and test(n)]

    def first(self, tag: str | None = None, test: Callable[[Node], bool] = lambda n: True) -> Node | None:
        return next((n for n in self.walk() if (tag is None or n.tag == tag) and test(n)), None)

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style", "template"):
                yield from c.texts()

    def text(self) -> str:
        """The visible text, joined by single blanks."""
        return " ".join(" ".join(self.texts()).split())

    def raw(self) -> str:
        """The text as it stands, of a script too."""
        return "".join(c if isinstance(c, str) else c.raw() for c in self.children)

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def has_class(self, name: str) -> bool:
        return name in self.get("class").split()

    def above(self, tag: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag != tag:
            n = n.parent
        return n

    def after(self) -> list[Node]:
        """The elements beside this one that come after it."""
        if self.parent is None:
            return []
        beside = self.parent.elements()
        return beside[next(i for i, n in enumerate(beside) if n is self) + 1 :]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSED_BY.get(self.at.tag, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        # An end tag without a start is passed over.
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; broken markup gives what can be made of it."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root

"""Tree construction after the HTML standard: implied tags, active formatting, foster parenting, foreign content."""

from __future__ import annotations

from webloom.html.node import COMMENT, DOCUMENT, ELEMENT, HTML, MATHML, SVG, TEXT, VOID, Node, number
from webloom.html.tokens import LOWER, Tokens

# The standard's element classes (fixed values).
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
TABLE_SCOPE = frozenset("html table template".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta title noframes style script template noscript".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SVG_TAGS = {t.lower(): t for t in "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath".split()}
MATH_TEXT = frozenset("mi mo mn ms mtext".split())
SVG_HTML = frozenset("foreignObject desc title".split())
_WHITE = "\t\n\f "


class Builder:
    def __init__(self, text: str):
        self.tokens = Tokens(text)
        self.doc = Node(DOCUMENT)
        self.stack: list[Node] = []
        self.active: list[Node | None] = []
        self.mode = self.initial
        self.original = None
        self.head: Node | None = None
        self.form: Node | None = None
        self.foster = False
        self.skip_line = False
        self.table_text: list[str] = []
        self.frames_ok = True

    def build(self) -> Node:
        while (token := self.tokens.next()) is not None:
            self.process(token)
        self.end()
        number(self.doc)
        return self.doc

    # -- dispatch -------------------------------------------------------------------------------------

    def process(self, token) -> None:
        if self.skip_line:
            self.skip_line = False
            if token[0] == "text" and token[1].startswith("\n"):
                token = ("text", token[1][1:])
                if not token[1]:
                    return
        if self.table_text and not (token[0] == "text" and self.mode == self.in_table):
            self.flush_table_text()
        if self.stack and self.is_foreign(token):
            self.foreign(token)
        else:
            self.mode(token)
        self.tokens.cdata = bool(self.stack) and self.stack[-1].ns != HTML

    def is_foreign(self, token) -> bool:
        here = self.stack[-1]
        if here.ns == HTML:
            return False
        if here.ns == MATHML and here.tag in MATH_TEXT and (token[0] == "text" or token[0] == "start" and token[1] not in ("mglyph", "malignmark")):
            return False
        if here.ns == MATHML and here.tag == "annotation-xml":
            if token[0] == "start" and token[1] == "svg":
                return False
            if here.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml") and token[0] in ("start", "text"):
                return False
        return not (here.ns == SVG and here.tag in SVG_HTML and token[0] in ("start", "text"))

    def end(self) -> None:
        if self.table_text:
            self.flush_table_text()
        if not self.stack:
            self.start_html({})
        if self.head is None:
            self.head = self.insert("head", {})
            self.stack.pop()
        if not any(c.tag in ("body", "frameset") for c in self.doc.children[-1].children if c.kind == ELEMENT) and len(self.stack) == 1:
            self.insert("body", {})

    # -- building blocks ------------------------------------------------------------------------------

    def place(self, override: Node | None = None) -> tuple[Node, Node | None]:
        """Where a node goes: (parent, the sibling it stands before or None)."""
        target = override or self.stack[-1]
        if self.foster and target.ns == HTML and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1, -1, -1):
                n = self.stack[i]
                if n.tag == "template" and n.ns == HTML:
                    return n, None
                if n.tag == "table" and n.ns == HTML:
                    return (n.parent, n) if n.parent is not None else (self.stack[i - 1], None)
            return self.stack[0], None
        return target, None

    def put(self, node: Node, override: Node | None = None) -> None:
        parent, before = self.place(override)
        if before is None:
            parent.append(node)
        else:
            parent.insert_before(node, before)

    def insert(self, tag: str, attrs: dict[str, str], ns: str = HTML) -> Node:
        node = Node(ELEMENT, tag, attrs, ns=ns)
        if self.stack:
            self.put(node)
        else:
            self.doc.append(node)
        self.stack.append(node)
        return node

    def add_text(self, text: str) -> None:
        if not text:
            return
        parent, before = self.place()
        if parent.kind == DOCUMENT:
            return
        if before is None:
            last = parent.children[-1] if parent.children else None
        else:
            i = next(i for i, c in enumerate(parent.children) if c is before)
            last = parent.children[i - 1] if i else None
        if last is not None and last.kind == TEXT:
            last.text += text
        elif before is None:
            parent.append(Node(TEXT, text=text))
        else:
            parent.insert_before(Node(TEXT, text=text), before)

    def add_comment(self, text: str, parent: Node | None = None) -> None:
        node = Node(COMMENT, text=text)
        if parent is not None:
            parent.append(node)
        elif self.stack:
            self.put(node)
        else:
            self.doc.append(node)

    def start_html(self, attrs: dict[str, str]) -> None:
        self.insert("html", attrs)

    def in_scope(self, tags, stops=SCOPE) -> bool:
        tags = (tags,) if isinstance(tags, str) else tags
        for n in reversed(self.stack):
            if n.ns == HTML:
                if n.tag in tags:
                    return True
                if n.tag in stops:
                    return False
            elif stops is not TABLE_SCOPE and (n.ns == MATHML and (n.tag in MATH_TEXT or n.tag == "annotation-xml") or n.ns == SVG and n.tag in SVG_HTML):
                return False
        return False

    def button_scope(self, tag: str) -> bool:
        return self.in_scope(tag, SCOPE | {"button"})

    def implied_ends(self, but: str = "") -> None:
        while self.stack[-1].ns == HTML and self.stack[-1].tag in IMPLIED and self.stack[-1].tag != but:
            self.stack.pop()

    def pop_to(self, tags) -> None:
        tags = (tags,) if isinstance(tags, str) else tags
        while self.stack:
            n = self.stack.pop()
            if n.ns == HTML and n.tag in tags:
                return

    def close_p(self) -> None:
        if self.button_scope("p"):
            self.implied_ends("p")
            self.pop_to("p")

    def clear_to(self, tags) -> None:
        while self.stack[-1].tag not in tags and self.stack[-1].tag not in ("html", "template"):
            self.stack.pop()

    def raw_text(self, tag: str, attrs: dict[str, str], references: bool = False) -> None:
        self.insert(tag, attrs)
        self.tokens.raw, self.tokens.references = tag, references
        self.original, self.mode = self.mode, self.in_text

    def push_active(self, node: Node) -> None:
        same = 0
        for i in range(len(self.active) - 1, -1, -1):
            n = self.active[i]
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same += 1
                if same == 3:
                    del self.active[i]
                    break
        self.active.append(node)

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or any(n is self.active[-1] for n in self.stack):
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and not any(n is self.active[i - 1] for n in self.stack):
            i -= 1
        for k in range(i, len(self.active)):
            n = self.active[k]
            self.active[k] = self.insert(n.tag, dict(n.attrs))

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adoption(self, tag: str) -> bool:
        """The adoption agency; False if the tag is to be treated as any other end tag."""
        here = self.stack[-1]
        if here.tag == tag and here.ns == HTML and not any(n is here for n in self.active):
            self.stack.pop()
            return True
        for _ in range(8):
            element = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    element = n
                    break
            if element is None:
                return False
            at = next((i for i, n in enumerate(self.stack) if n is element), -1)
            if at < 0:
                self.active = [n for n in self.active if n is not element]
                return True
            if not self.in_scope(tag):
                return True
            furthest = next((i for i in range(at + 1, len(self.stack)) if self.stack[i].ns == HTML and self.stack[i].tag in SPECIAL or self.stack[i].ns == SVG and self.stack[i].tag in SVG_HTML), -1)
            if furthest < 0:
                del self.stack[at:]
                self.active = [n for n in self.active if n is not element]
                return True
            block, above = self.stack[furthest], self.stack[at - 1]
            bookmark = next(i for i, n in enumerate(self.active) if n is element)
            last, i, inner = block, furthest, 0
            while True:
                inner += 1
                i -= 1
                node = self.stack[i]
                if node is element:
                    break
                known = next((k for k, n in enumerate(self.active) if n is node), -1)
                if inner > 3 and known >= 0:
                    del self.active[known]
                    if known < bookmark:
                        bookmark -= 1
                    known = -1
                if known < 0:
                    del self.stack[i]
                    continue
                clone = Node(ELEMENT, node.tag, dict(node.attrs))
                self.active[known] = self.stack[i] = clone
                if last is block:
                    bookmark = known + 1
                last.detach()
                clone.append(last)
                last = clone
            last.detach()
            was, self.foster = self.foster, True
            self.put(last, above)
            self.foster = was
            clone = Node(ELEMENT, element.tag, dict(element.attrs))
            for c in block.children:
                c.parent = clone
            clone.children, block.children = block.children, []
            block.append(clone)
            old = next(k for k, n in enumerate(self.active) if n is element)
            del self.active[old]
            self.active.insert(bookmark - (old < bookmark), clone)
            self.stack = [n for n in self.stack if n is not element]
            self.stack.insert(next(k for k, n in enumerate(self.stack) if n is block) + 1, clone)
        return True

    def reset_mode(self) -> None:
        for n in reversed(self.stack):
            mode = {
                "select": self.in_select, "td": self.in_cell, "th": self.in_cell, "tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body,
                "caption": self.in_caption, "colgroup": self.in_column_group, "table": self.in_table, "template": self.in_body, "body": self.in_body, "html": self.in_body if self.head else self.before_head,
            }.get(n.tag) if n.ns == HTML else None
            if mode is not None and not (n.tag in ("td", "th") and n is self.stack[0]):
                self.mode = mode
                return
        self.mode = self.in_body

    # -- modes ----------------------------------------------------------------------------------------

    def initial(self, t) -> None:
        if t[0] == "comment":
            return self.add_comment(t[1])
        if t[0] == "doctype":
            self.mode = self.before_html
            return None
        if t[0] == "text":
            rest = t[1].lstrip(_WHITE)
            if not rest:
                return None
            t = ("text", rest)
        self.mode = self.before_html
        return self.mode(t)

    def before_html(self, t) -> None:
        if t[0] == "comment":
            return self.add_comment(t[1])
        if t[0] == "doctype":
            return None
        if t[0] == "text":
            rest = t[1].lstrip(_WHITE)
            if not rest:
                return None
            t = ("text", rest)
        if t[0] == "start" and t[1] == "html":
            self.start_html(t[2])
            self.mode = self.before_head
            return None
        if t[0] == "end" and t[1] not in ("head", "body", "html", "br"):
            return None
        self.start_html({})
        self.mode = self.before_head
        return self.mode(t)

    def before_head(self, t) -> None:
        if t[0] == "text":
            rest = t[1].lstrip(_WHITE)
            if not rest:
                return None
            t = ("text", rest)
        elif t[0] == "comment":
            return self.add_comment(t[1])
        elif t[0] == "doctype":
            return None
        elif t[0] == "start" and t[1] == "html":
            return self.in_body(t)
        elif t[0] == "start" and t[1] == "head":
            self.head = self.insert("head", t[2])
            self.mode = self.in_head
            return None
        elif t[0] == "end" and t[1] not in ("head", "body", "html", "br"):
            return None
        self.head = self.insert("head", {})
        self.mode = self.in_head
        return self.mode(t)

    def in_head(self, t) -> None:
        if t[0] == "text":
            rest = t[1].lstrip(_WHITE)
            self.add_text(t[1][: len(t[1]) - len(rest)])
            if not rest:
                return None
            t = ("text", rest)
        elif t[0] == "comment":
            return self.add_comment(t[1])
        elif t[0] == "doctype":
            return None
        elif t[0] == "start":
            tag = t[1]
            if tag == "html":
                return self.in_body(t)
            if tag in ("base", "basefont", "bgsound", "link", "meta"):
                self.insert(tag, t[2])
                self.stack.pop()
                return None
            if tag == "title":
                return self.raw_text(tag, t[2], True)
            if tag in ("noscript", "noframes", "style", "script"):
                return self.raw_text(tag, t[2])
            if tag == "template":
                self.insert(tag, t[2])
                self.active.append(None)
                if self.mode in (self.in_head, self.after_head):
                    self.mode = self.in_body
                return None
            if tag == "head":
                return None
        elif t[0] == "end":
            if t[1] == "head":
                self.stack.pop()
                self.mode = self.after_head
                return None
            if t[1] == "template":
                return self.end_template()
            if t[1] not in ("body", "html", "br"):
                return None
        if self.stack[-1].tag == "head":
            self.stack.pop()
        self.mode = self.after_head
        return self.mode(t)

    def end_template(self) -> None:
        if any(n.tag == "template" for n in self.stack):
            self.pop_to("template")
            self.clear_active()
            self.reset_mode()
            if self.stack[-1].tag == "head":
                self.mode = self.in_head
            elif len(self.stack) == 1:
                self.mode = self.after_head

    def after_head(self, t) -> None:
        if t[0] == "text":
            rest = t[1].lstrip(_WHITE)
            self.add_text(t[1][: len(t[1]) - len(rest)])
            if not rest:
                return None
            t = ("text", rest)
        elif t[0] == "comment":
            return self.add_comment(t[1])
        elif t[0] == "doctype":
            return None
        elif t[0] == "start":
            if t[1] == "html":
                return self.in_body(t)
            if t[1] == "body":
                self.insert("body", t[2])
                self.mode = self.in_body
                return None
            if t[1] == "frameset":
                self.insert("frameset", t[2])
                self.mode = self.in_body
                return None
            if t[1] in HEAD_TAGS:
                self.stack.append(self.head)
                self.in_head(t)
                if self.mode != self.in_text:
                    self.stack = [n for n in self.stack if n is not self.head]
                else:
                    self.stack.remove(self.head)
                return None
            if t[1] == "head":
                return None
        elif t[0] == "end":
            if t[1] == "template":
                return self.end_template()
            if t[1] not in ("body", "html", "br"):
                return None
        self.insert("body", {})
        self.mode = self.in_body
        return self.process(t)

    def in_text(self, t) -> None:
        if t[0] == "text":
            if self.stack[-1].tag == "textarea" and not self.stack[-1].children and t[1].startswith("\n"):
                t = ("text", t[1][1:])
            return self.add_text(t[1])
        self.stack.pop()
        self.mode = self.original
        if not (t[0] == "end"):
            self.process(t)
        return None

    def in_body(self, t) -> None:
        kind = t[0]
        if kind == "text":
            text = t[1].replace("\0", "")
            if text:
                self.reconstruct()
                self.add_text(text)
        elif kind == "comment":
            self.add_comment(t[1])
        elif kind == "start":
            self.body_start(t[1], t[2], t[3], t)
        elif kind == "end":
            self.body_end(t[1], t)

    def body_start(self, tag: str, attrs: dict[str, str], closing: bool, t) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.stack[0].attrs.setdefault(k, v)
        elif tag == "body":
            body = next((n for n in self.stack[1:2] if n.tag == "body"), None)
            if body is not None:
                for k, v in attrs.items():
                    body.attrs.setdefault(k, v)
        elif tag in HEAD_TAGS and tag != "noscript":
            self.in_head(t)
        elif tag in BLOCKS:
            self.close_p()
            self.insert(tag, attrs)
        elif tag in HEADINGS:
            self.close_p()
            if self.stack[-1].tag in HEADINGS:
                self.stack.pop()
            self.insert(tag, attrs)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.insert(tag, attrs)
            self.skip_line = True
        elif tag == "form":
            if self.form is None:
                self.close_p()
                self.form = self.insert(tag, attrs)
        elif tag == "li" or tag in ("dd", "dt"):
            group = ("li",) if tag == "li" else ("dd", "dt")
            for n in reversed(self.stack):
                if n.tag in group:
                    self.implied_ends(n.tag)
                    self.pop_to(n.tag)
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "plaintext":
            self.close_p()
            self.insert(tag, attrs)
            self.tokens.raw = "plaintext"
        elif tag == "button":
            if self.in_scope("button"):
                self.implied_ends()
                self.pop_to("button")
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.adoption("a")
                    self.active = [x for x in self.active if x is not n]
                    self.stack = [x for x in self.stack if x is not n]
                    break
            self.reconstruct()
            self.push_active(self.insert(tag, attrs))
        elif tag in FORMATTING:
            self.reconstruct()
            if tag == "nobr" and self.in_scope("nobr"):
                self.adoption("nobr")
                self.reconstruct()
            self.push_active(self.insert(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.active.append(None)
        elif tag == "table":
            self.close_p()
            self.insert(tag, attrs)
            self.mode = self.in_table
        elif tag in ("area", "br", "embed", "img", "keygen", "wbr", "input", "image"):
            self.reconstruct()
            self.insert("img" if tag == "image" else tag, attrs)
            self.stack.pop()
        elif tag in ("param", "source", "track"):
            self.insert(tag, attrs)
            self.stack.pop()
        elif tag == "hr":
            self.close_p()
            self.insert(tag, attrs)
            self.stack.pop()
        elif tag == "textarea":
            self.raw_text(tag, attrs, True)
        elif tag == "xmp":
            self.close_p()
            self.reconstruct()
            self.raw_text(tag, attrs)
        elif tag in ("iframe", "noembed", "noscript"):
            self.raw_text(tag, attrs)
        elif tag == "select":
            self.reconstruct()
            self.insert(tag, attrs)
            self.mode = self.in_select
        elif tag in ("optgroup", "option"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.implied_ends("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        elif tag in ("math", "svg"):
            self.reconstruct()
            self.insert(tag, _foreign_attrs(attrs), MATHML if tag == "math" else SVG)
            if closing:
                self.stack.pop()
        elif tag in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if any(n.tag == "template" for n in self.stack):
                self.insert(tag, attrs)
                if tag == "col":
                    self.stack.pop()
        else:
            self.reconstruct()
            self.insert(tag, attrs)

    def body_end(self, tag: str, t) -> None:
        if tag == "template":
            self.end_template()
        elif tag in ("body", "html"):
            if self.in_scope("body"):
                self.mode = self.after_body
        elif tag in BLOCKS - {"p"} or tag in ("button", "listing", "pre"):
            if self.in_scope(tag):
                self.implied_ends()
                self.pop_to(tag)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and any(n is node for n in self.stack) and self.in_scope("form"):
                self.implied_ends()
                self.stack = [n for n in self.stack if n is not node]
        elif tag == "p":
            if not self.button_scope("p"):
                self.insert("p", {})
            self.close_p()
        elif tag == "li":
            if self.in_scope("li", SCOPE | {"ol", "ul"}):
                self.implied_ends("li")
                self.pop_to("li")
        elif tag in ("dd", "dt"):
            if self.in_scope(tag):
                self.implied_ends(tag)
                self.pop_to(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied_ends()
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            if not self.adoption(tag):
                self.any_end(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.implied_ends()
                self.pop_to(tag)
                self.clear_active()
        elif tag == "br":
            self.body_start("br", {}, False, ("start", "br", {}, False))
        else:
            self.any_end(tag)

    def any_end(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            n = self.stack[i]
            if n.ns == HTML and n.tag == tag:
                self.implied_ends(tag)
                del self.stack[next(k for k, x in enumerate(self.stack) if x is n) :]
                return
            if n.ns == HTML and n.tag in SPECIAL:
                return

    def after_body(self, t) -> None:
        if t[0] == "comment":
            return self.add_comment(t[1], self.stack[0])
        if t[0] == "doctype" or t[0] == "end" and t[1] == "html":
            return None
        if t[0] == "text" and not t[1].strip(_WHITE):
            return self.in_body(t)
        self.mode = self.in_body
        return self.process(t)

    # -- tables ---------------------------------------------------------------------------------------

    def flush_table_text(self) -> None:
        text, self.table_text = "".join(self.table_text).replace("\0", ""), []
        if text.strip(_WHITE):
            self.fostered(("text", text))
        else:
            self.add_text(text)

    def fostered(self, t) -> None:
        self.foster = True
        self.in_body(t)
        self.foster = False

    def in_table(self, t) -> None:
        if t[0] == "text":
            if self.stack[-1].tag in ("table", "tbody", "tfoot", "thead", "tr"):
                self.table_text.append(t[1])
                return None
            return self.fostered(t)
        if t[0] == "comment":
            return self.add_comment(t[1])
        if t[0] == "doctype":
            return None
        tag = t[1]
        if t[0] == "start":
            if tag == "caption":
                self.clear_to(("table",))
                self.active.append(None)
                self.insert(tag, t[2])
                self.mode = self.in_caption
                return None
            if tag in ("colgroup", "col"):
                self.clear_to(("table",))
                self.insert("colgroup", t[2] if tag == "colgroup" else {})
                self.mode = self.in_column_group
                return None if tag == "colgroup" else self.mode(t)
            if tag in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to(("table",))
                own = tag in ("tbody", "tfoot", "thead")
                self.insert(tag if own else "tbody", t[2] if own else {})
                self.mode = self.in_table_body
                return None if own else self.mode(t)
            if tag == "table":
                if self.in_scope("table", TABLE_SCOPE):
                    self.pop_to("table")
                    self.reset_mode()
                    return self.process(t)
                return None
            if tag in ("style", "script", "template"):
                return self.in_head(t)
            if tag == "input" and t[2].get("type", "").lower() == "hidden":
                self.insert(tag, t[2])
                self.stack.pop()
                return None
            if tag == "form":
                if self.form is None:
                    self.form = self.insert(tag, t[2])
                    self.stack.pop()
                return None
        elif tag == "table":
            if self.in_scope("table", TABLE_SCOPE):
                self.pop_to("table")
                self.reset_mode()
            return None
        elif tag == "template":
            return self.end_template()
        elif tag in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return None
        return self.fostered(t)

    def in_caption(self, t) -> None:
        closes = t[0] == "end" and t[1] in ("caption", "table") or t[0] == "start" and t[1] in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if not closes:
            if t[0] == "end" and t[1] in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                return None
            return self.in_body(t)
        if self.in_scope("caption", TABLE_SCOPE):
            self.implied_ends()
            self.pop_to("caption")
            self.clear_active()
            self.mode = self.in_table
            if not (t[0] == "end" and t[1] == "caption"):
                return self.mode(t)
        return None

    def in_column_group(self, t) -> None:
        if t[0] == "text":
            rest = t[1].lstrip(_WHITE)
            self.add_text(t[1][: len(t[1]) - len(rest)])
            if not rest:
                return None
            t = ("text", rest)
        elif t[0] == "comment":
            return self.add_comment(t[1])
        elif t[0] == "start" and t[1] == "col":
            self.insert("col", t[2])
            self.stack.pop()
            return None
        elif t[0] == "end" and t[1] == "col" or t[0] == "doctype":
            return None
        elif t[0] in ("start", "end") and t[1] == "template":
            return self.in_head(t)
        if self.stack[-1].tag == "colgroup":
            self.stack.pop()
            self.mode = self.in_table
            if not (t[0] == "end" and t[1] == "colgroup"):
                return self.mode(t)
        return None

    def in_table_body(self, t) -> None:
        if t[0] == "start":
            if t[1] in ("tr", "td", "th"):
                self.clear_to(("tbody", "tfoot", "thead"))
                self.insert("tr", t[2] if t[1] == "tr" else {})
                self.mode = self.in_row
                return None if t[1] == "tr" else self.mode(t)
            leaves = t[1] in ("caption", "col", "colgroup", "tbody", "tfoot", "thead")
        else:
            if t[0] == "end" and t[1] in ("tbody", "tfoot", "thead"):
                if self.in_scope(t[1], TABLE_SCOPE):
                    self.clear_to(("tbody", "tfoot", "thead"))
                    self.stack.pop()
                    self.mode = self.in_table
                return None
            leaves = t[0] == "end" and t[1] == "table"
            if t[0] == "end" and t[1] in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
                return None
        if leaves:
            if self.in_scope(("tbody", "thead", "tfoot"), TABLE_SCOPE):
                self.clear_to(("tbody", "tfoot", "thead"))
                self.stack.pop()
                self.mode = self.in_table
                return self.mode(t)
            return None
        return self.table_rest(t)

    def table_rest(self, t) -> None:
        """As in a table, but text waits in the mode it came in."""
        if t[0] == "text":
            if self.stack[-1].tag in ("table", "tbody", "tfoot", "thead", "tr"):
                if t[1].strip(_WHITE):
                    return self.fostered(t)
                return self.add_text(t[1])
        return self.in_table(t)

    def in_row(self, t) -> None:
        if t[0] == "start" and t[1] in ("td", "th"):
            self.clear_to(("tr",))
            self.insert(t[1], t[2])
            self.mode = self.in_cell
            self.active.append(None)
            return None
        ends = t[0] == "end" and t[1] == "tr"
        leaves = t[0] == "start" and t[1] in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr") or t[0] == "end" and t[1] in ("table", "tbody", "tfoot", "thead")
        if ends or leaves:
            if leaves and t[0] == "end" and t[1] != "table" and not self.in_scope(t[1], TABLE_SCOPE):
                return None
            if self.in_scope("tr", TABLE_SCOPE):
                self.clear_to(("tr",))
                self.stack.pop()
                self.mode = self.in_table_body
                return None if ends else self.mode(t)
            return None
        if t[0] == "end" and t[1] in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return None
        return self.table_rest(t)

    def in_cell(self, t) -> None:
        if t[0] == "end" and t[1] in ("td", "th"):
            if self.in_scope(t[1], TABLE_SCOPE):
                self.implied_ends()
                self.pop_to(t[1])
                self.clear_active()
                self.mode = self.in_row
            return None
        leaves = t[0] == "start" and t[1] in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr") or t[0] == "end" and t[1] in ("table", "tbody", "tfoot", "thead", "tr")
        if leaves:
            if t[0] == "end" and not self.in_scope(t[1], TABLE_SCOPE) or not self.in_scope(("td", "th"), TABLE_SCOPE):
                return None
            self.implied_ends()
            self.pop_to(("td", "th"))
            self.clear_active()
            self.mode = self.in_row
            return self.mode(t)
        if t[0] == "end" and t[1] in ("body", "caption", "col", "colgroup", "html"):
            return None
        return self.in_body(t)

    def in_select(self, t) -> None:
        if t[0] == "text":
            return self.add_text(t[1].replace("\0", ""))
        if t[0] == "comment":
            return self.add_comment(t[1])
        if t[0] == "start":
            tag = t[1]
            if tag in ("option", "optgroup", "hr"):
                if self.stack[-1].tag == "option":
                    self.stack.pop()
                if tag in ("optgroup", "hr") and self.stack[-1].tag == "optgroup":
                    self.stack.pop()
                self.insert(tag, t[2])
                if tag == "hr":
                    self.stack.pop()
            elif tag in ("select", "input", "keygen", "textarea") or tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
                self.pop_to("select")
                self.reset_mode()
                if tag != "select":
                    self.process(t)
            elif tag in ("script", "template"):
                self.in_head(t)
        elif t[0] == "end":
            tag = t[1]
            if tag == "optgroup":
                if self.stack[-1].tag == "option" and self.stack[-2].tag == "optgroup":
                    self.stack.pop()
                if self.stack[-1].tag == "optgroup":
                    self.stack.pop()
            elif tag == "option":
                if self.stack[-1].tag == "option":
                    self.stack.pop()
            elif tag == "select" or tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and self.in_scope(tag, TABLE_SCOPE):
                self.pop_to("select")
                self.reset_mode()
                if tag != "select":
                    self.process(t)
            elif tag == "template":
                self.end_template()
        return None

    # -- foreign content ------------------------------------------------------------------------------

    def foreign(self, t) -> None:
        if t[0] == "text":
            return self.add_text(t[1].replace("\0", "�"))
        if t[0] == "comment":
            return self.add_comment(t[1])
        if t[0] == "doctype":
            return None
        tag = t[1]
        if t[0] == "start":
            if tag in BREAKOUT or tag == "font" and {"color", "face", "size"} & t[2].keys():
                while self.stack[-1].ns != HTML and not (self.stack[-1].ns == SVG and self.stack[-1].tag in SVG_HTML or self.stack[-1].ns == MATHML and self.stack[-1].tag in MATH_TEXT):
                    self.stack.pop()
                return self.process(t)
            ns = self.stack[-1].ns
            self.insert(SVG_TAGS.get(tag, tag) if ns == SVG else tag, _foreign_attrs(t[2]), ns)
            if t[3]:
                self.stack.pop()
            return None
        if tag in ("br", "p"):
            while self.stack[-1].ns != HTML:
                self.stack.pop()
            return self.mode(t)
        for i in range(len(self.stack) - 1, 0, -1):
            n = self.stack[i]
            if n.ns == HTML:
                return self.mode(t)
            if n.tag.translate(LOWER) == tag:
                del self.stack[i:]
                return None
        return None


def _foreign_attrs(attrs: dict[str, str]) -> dict[str, str]:
    """Of attributes with a namespace prefix only the local name is kept."""
    out: dict[str, str] = {}
    for k, v in attrs.items():
        prefix, colon, local = k.partition(":")
        out.setdefault(local if colon and prefix in ("xlink", "xml", "xmlns") and local else k, v)
    return out


def parse(text: str) -> Node:
    return Builder(text).build()


__all__ = ["VOID", "Builder", "parse"]

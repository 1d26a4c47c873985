"""A small parser for script text: enough of the language to find constant strings and calls."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ScriptError(ValueError):
    """The text is no script."""


@dataclass(eq=False, slots=True)
class Node:
    """``kind`` is one of str, num, name, template, binary, dot, index, call, new, object, assign, declare, other."""

    kind: str
    value: object = None
    kids: list[Node] = field(default_factory=list)


_SPACE = re.compile(r"(?:[\s﻿]|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)+")
_NEWLINE = re.compile("[\n\r  ]")
_NAME = re.compile(r"(?:[^\W\d]|[$_]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:\w|[$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*")
_NUMBER = re.compile(r"0[xX][0-9A-Fa-f_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?n?")
_PUNCTUATION = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/\w*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())


def _unescape(raw: str) -> str:
    out, i = [], 0
    while i < len(raw):
        c = raw[i]
        if c != "\\":
            out.append(c)
            i += 1
            continue
        c = raw[i + 1 : i + 2]
        i += 2
        if c == "x" and re.match(r"[0-9A-Fa-f]{2}", raw[i : i + 2]):
            out.append(chr(int(raw[i : i + 2], 16)))
            i += 2
        elif c == "u" and (m := re.match(r"([0-9A-Fa-f]{4})|\{([0-9A-Fa-f]{1,6})\}", raw[i : i + 8])):
            code = int(m.group(1) or m.group(2), 16)
            if code > 0x10FFFF:
                raise ScriptError("escape")
            out.append(chr(code))
            i += m.end()
        elif c in ("x", "u"):
            raise ScriptError("escape")
        elif c == "\r" and raw[i : i + 1] == "\n":
            i += 1
        elif c not in "\n\r  ":
            out.append(_ESCAPES.get(c, c))
    # Pairs of surrogates become characters; a lone one can't be in a text.
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Parser:
    """One pass over the text, a token at a time; ``program`` gives the tree."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        if text.startswith("#!"):
            self.at = len(text.split("\n", 1)[0])
        self.functions = 0
        self.no_arrows: set[int] = set()  # brackets that are known to begin no arrow function
        self.advance()

    # ------------------------------------------------------------ tokens

    def advance(self) -> None:
        """Next token: ``kind`` (name, num, str, punct, tick, end), ``token`` (its text or value), ``start``, ``newline`` (before it)."""
        text = self.text
        space = _SPACE.match(text, self.at)
        self.newline = bool(space) and _NEWLINE.search(space.group()) is not None
        self.start = at = space.end() if space else self.at
        if at >= len(text):
            self.kind, self.token = "end", ""
            self.at = at
            return
        c = text[at]
        if c in "\"'":
            i = at + 1
            while True:
                if i >= len(text) or text[i] in "\n\r":
                    raise ScriptError("string")
                if text[i] == "\\":
                    i += 2
                elif text[i] == c:
                    break
                else:
                    i += 1
            self.kind, self.token, self.at = "str", _unescape(text[at + 1 : i]), i + 1
        elif c == "`":
            self.kind, self.token, self.at = "tick", "`", at + 1
        elif (c.isdigit() or c == ".") and (m := _NUMBER.match(text, at)):
            self.kind, self.token, self.at = "num", m.group(), m.end()
            if (rest := text[self.at : self.at + 1]) and (rest.isalnum() or rest in "_$"):
                raise ScriptError("number")
        elif m := _NAME.match(text, at):
            word = m.group()
            self.kind, self.token, self.at = "name", _unescape(word) if "\\" in word else word, m.end()
        elif m := _PUNCTUATION.match(text, at):
            self.kind, self.token, self.at = "punct", m.group(), m.end()
        else:
            raise ScriptError(f"character {c!r}")

    def is_(self, *tokens: str) -> bool:
        return self.kind in ("punct", "name") and self.token in tokens

    def take(self, *tokens: str) -> bool:
        if self.is_(*tokens):
            self.advance()
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise ScriptError(f"{token} wanted, {self.token} found")

    def name(self) -> str:
        if self.kind != "name" or self.token in _RESERVED:
            raise ScriptError(f"name wanted, {self.token} found")
        word = self.token
        self.advance()
        return word

    def end_of_statement(self) -> None:
        if not self.take(";") and not self.is_("}") and self.kind != "end" and not self.newline:
            raise ScriptError(f"unexpected {self.token}")

    def mark(self) -> tuple:
        return self.at, self.start, self.kind, self.token, self.newline

    def back(self, mark: tuple) -> None:
        self.at, self.start, self.kind, self.token, self.newline = mark

    # ------------------------------------------------------------ statements

    def program(self) -> Node:
        body = []
        while self.kind != "end":
            body.append(self.statement())
        return Node("other", None, body)

    def block(self) -> Node:
        self.need("{")
        body = []
        while not self.is_("}"):
            if self.kind == "end":
                raise ScriptError("unclosed block")
            body.append(self.statement())
        self.advance()
        return Node("other", None, body)

    def condition(self) -> Node:
        self.need("(")
        node = self.expression()
        self.need(")")
        return node

    def statement(self) -> Node:
        if self.kind == "punct":
            if self.token == "{":
                return self.block()
            if self.take(";"):
                return Node("other")
        if self.kind == "name":
            word = self.token
            own = getattr(self, f"_{word}", None) if word in ("if", "for", "while", "do", "switch", "try", "return", "throw", "with") else None
            if own:
                self.advance()
                return own()
            if word in ("var", "const") or word == "let" and self._declares():
                self.advance()
                node = self.declarations()
                self.end_of_statement()
                return node
            if word == "function" or word == "async" and self._ahead("function"):
                if word == "async":
                    self.advance()
                self.advance()
                return self.function(True)
            if word == "class":
                self.advance()
                return self.class_()
            if word in ("break", "continue", "debugger"):
                self.advance()
                if self.kind == "name" and not self.newline and word != "debugger":
                    self.name()
                self.end_of_statement()
                return Node("other")
            if word in ("import", "export") and not (word == "import" and self._ahead("(", ".")):
                raise ScriptError("modules aren't scripts")
            if word not in _RESERVED and self._ahead(":"):
                self.advance()
                self.advance()
                return self.statement()
        node = self.expression()
        self.end_of_statement()
        return node

    def _ahead(self, *tokens: str) -> bool:
        mark = self.mark()
        try:
            self.advance()
            return self.is_(*tokens)
        except ScriptError:
            return False
        finally:
            self.back(mark)

    def _declares(self) -> bool:
        mark = self.mark()
        try:
            self.advance()
            return self.kind == "name" and self.token not in ("in", "instanceof", "of") or self.is_("[", "{")
        finally:
            self.back(mark)

    def declarations(self, in_for: bool = False) -> Node:
        found = []
        while True:
            if self.is_("[", "{"):
                target, kids = None, [self.pattern()]
            else:
                target, kids = self.name(), []
            if self.take("="):
                kids.append(self.assignment(not in_for))
            found.append(Node("declare", target if len(kids) == 1 else None, kids) if kids else Node("other"))
            if not self.take(","):
                return Node("other", None, found)

    def _if(self) -> Node:
        kids = [self.condition(), self.statement()]
        if self.take("else"):
            kids.append(self.statement())
        return Node("other", None, kids)

    def _for(self) -> Node:
        self.take("await")
        self.need("(")
        kids = []
        if not self.is_(";"):
            if self.is_("var", "const") or self.is_("let") and self._declares():
                self.advance()
                kids.append(self.declarations(True))
            else:
                kids.append(self.expression(False))
        if self.take("of", "in"):
            kids.append(self.expression())
        else:
            self.need(";")
            if not self.is_(";"):
                kids.append(self.expression())
            self.need(";")
            if not self.is_(")"):
                kids.append(self.expression())
        self.need(")")
        return Node("other", None, [*kids, self.statement()])

    def _while(self) -> Node:
        return Node("other", None, [self.condition(), self.statement()])

    _with = _while

    def _do(self) -> Node:
        body = self.statement()
        self.need("while")
        node = Node("other", None, [body, self.condition()])
        self.take(";")
        return node

    def _switch(self) -> Node:
        kids = [self.condition()]
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                kids.append(self.expression())
                self.need(":")
            elif self.take("default"):
                self.need(":")
            else:
                if self.kind == "end":
                    raise ScriptError("unclosed switch")
                kids.append(self.statement())
        return Node("other", None, kids)

    def _try(self) -> Node:
        kids = [self.block()]
        handled = False
        if self.take("catch"):
            handled = True
            if self.take("("):
                self.pattern()
                self.need(")")
            kids.append(self.block())
        if self.take("finally"):
            handled = True
            kids.append(self.block())
        if not handled:
            raise ScriptError("try alone")
        return Node("other", None, kids)

    def _return(self) -> Node:
        if not self.functions:
            raise ScriptError("return outside of a function")
        if self.is_(";", "}") or self.kind == "end" or self.newline:
            self.end_of_statement()
            return Node("other")
        node = self.expression()
        self.end_of_statement()
        return Node("other", None, [node])

    def _throw(self) -> Node:
        if self.newline:
            raise ScriptError("throw alone")
        node = self.expression()
        self.end_of_statement()
        return Node("other", None, [node])

    # ------------------------------------------------------------ functions and classes

    def pattern(self) -> Node:
        """A binding target; its defaults and computed keys are kept."""
        if self.take("["):
            kids = []
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                kids.append(self.element())
                if not self.is_("]"):
                    self.need(",")
            return Node("other", None, kids)
        if self.take("{"):
            kids = []
            while not self.take("}"):
                if self.take("..."):
                    kids.append(self.pattern())
                else:
                    key, computed = self.key()
                    kids.extend(computed)
                    if self.take(":"):
                        kids.append(self.element())
                    elif self.take("="):
                        kids.append(self.assignment())
                    elif key is None:
                        raise ScriptError("pattern")
                if not self.is_("}"):
                    self.need(",")
            return Node("other", None, kids)
        self.name()
        return Node("other")

    def element(self) -> Node:
        kids = [self.pattern()]
        if self.take("="):
            kids.append(self.assignment())
        return Node("other", None, kids)

    def parameters(self) -> list[Node]:
        self.need("(")
        kids = []
        while not self.take(")"):
            self.take("...")
            kids.append(self.element())
            if not self.is_(")"):
                self.need(",")
        return kids

    def body(self) -> Node:
        self.functions += 1
        node = self.block()
        self.functions -= 1
        return node

    def function(self, named: bool) -> Node:
        self.take("*")
        if self.kind == "name":
            self.name()
        elif named:
            raise ScriptError("function without name")
        return Node("other", None, [*self.parameters(), self.body()])

    def key(self) -> tuple[str | None, list[Node]]:
        """A property's name, or None with the expression that computes it."""
        if self.take("["):
            node = self.assignment()
            self.need("]")
            return None, [node]
        if self.kind == "num":
            value = number_text(self.token)
        elif self.kind in ("name", "str"):
            value = self.token
        elif self.take("#"):
            return "#" + self.key()[0], []
        else:
            raise ScriptError(f"property name wanted, {self.token} found")
        self.advance()
        return value, []

    def class_(self) -> Node:
        kids = []
        if self.kind == "name" and self.token not in ("extends",) and not self.is_("{"):
            self.name()
        if self.take("extends"):
            kids.append(self.unary())
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            if self.kind == "end":
                raise ScriptError("unclosed class")
            while self.is_("static", "async", "get", "set") and not self._ahead("(", "=", ";", "}"):
                self.advance()
                if self.is_("{"):
                    kids.append(self.body())
                    break
            else:
                self.take("*")
                kids.extend(self.key()[1])
                if self.is_("("):
                    kids.extend([*self.parameters(), self.body()])
                else:
                    if self.take("="):
                        kids.append(self.assignment())
                    self.end_of_statement()
        return Node("other", None, kids)

    # ------------------------------------------------------------ expressions

    def expression(self, with_in: bool = True) -> Node:
        node = self.assignment(with_in)
        if not self.is_(","):
            return node
        kids = [node]
        while self.take(","):
            kids.append(self.assignment(with_in))
        return Node("other", None, kids)

    def assignment(self, with_in: bool = True) -> Node:
        if (arrow := self.arrow(with_in)) is not None:
            return arrow
        if self.is_("yield") and self.functions:
            self.advance()
            self.take("*")
            if self.newline or self.kind == "end" or self.is_(")", "]", "}", ",", ";", ":"):
                return Node("other")
            return Node("other", None, [self.assignment(with_in)])
        left = self.conditional(with_in)
        if self.kind == "punct" and self.token in _ASSIGN:
            if left.kind not in ("name", "dot", "index", "object", "array"):
                raise ScriptError("assignment to a value")
            operator = self.token
            self.advance()
            return Node("assign", operator, [left, self.assignment(with_in)])
        return left

    def arrow(self, with_in: bool) -> Node | None:
        """An arrow function, if one begins here; otherwise nothing is taken."""
        if self.kind == "name" and self.token not in _RESERVED:
            mark = self.mark()
            if self.token == "async":
                self.advance()
                if self.newline or not (self.kind == "name" and self.token not in _RESERVED or self.is_("(")):
                    self.back(mark)
            if self.kind == "name":
                self.advance()
                if self.is_("=>") and not self.newline:
                    self.advance()
                    return self.arrow_body([], with_in)
                self.back(mark)
                return None
            if not self.is_("("):
                self.back(mark)
                return None
        elif self.is_("("):
            mark = self.mark()
        else:
            return None
        if self.start in self.no_arrows:
            self.back(mark)
            return None
        start, functions = self.start, self.functions
        try:
            parameters = self.parameters()
            found = self.is_("=>") and not self.newline
        except ScriptError:
            found = False
        if not found:
            self.no_arrows.add(start)
            self.functions = functions
            self.back(mark)
            return None
        return self.arrow_body(parameters, with_in)

    def arrow_body(self, parameters: list[Node], with_in: bool) -> Node:
        if self.kind == "punct" and self.token == "=>":
            self.advance()
        if self.is_("{"):
            return Node("other", None, [*parameters, self.body()])
        return Node("other", None, [*parameters, self.assignment(with_in)])

    def conditional(self, with_in: bool) -> Node:
        node = self.binary(0, with_in)
        if self.take("?"):
            yes = self.assignment()
            self.need(":")
            return Node("other", None, [node, yes, self.assignment(with_in)])
        return node

    def binary(self, least: int, with_in: bool) -> Node:
        left = self.unary()
        while self.kind in ("punct", "name") and (power := _BINARY.get(self.token, 0)) > least and (with_in or self.token != "in"):
            operator = self.token
            self.advance()
            right = self.binary(power - (operator == "**"), with_in)
            left = Node("binary", operator, [left, right])
        return left

    def unary(self) -> Node:
        operators = 0
        while self.is_("!", "~", "+", "-", "++", "--", "typeof", "void", "delete") or self.is_("await") and not self._ahead(")", ",", ";", "=", ".", "=>"):
            self.advance()
            operators += 1
        node = self.postfix()
        return Node("other", None, [node]) if operators else node

    def postfix(self) -> Node:
        node = self.chain(self.primary())
        if self.is_("++", "--") and not self.newline:
            self.advance()
            return Node("other", None, [node])
        return node

    def arguments(self) -> list[Node]:
        self.need("(")
        kids = []
        while not self.take(")"):
            spread = self.take("...")
            node = self.assignment()
            kids.append(Node("other", None, [node]) if spread else node)
            if not self.is_(")"):
                self.need(",")
        return kids

    def chain(self, node: Node, calls: bool = True) -> Node:
        while True:
            if self.kind == "tick":
                node = Node("other", None, [node, self.template()])
            elif self.is_("."):
                self.advance()
                self.take("#")
                if self.kind != "name":
                    raise ScriptError("member name wanted")
                node = Node("dot", self.token, [node])
                self.advance()
            elif self.is_("["):
                self.advance()
                node = Node("index", None, [node, self.expression()])
                self.need("]")
            elif calls and self.is_("("):
                node = Node("call", None, [node, *self.arguments()])
            elif calls and self.is_("?."):
                self.advance()
                if self.is_("("):
                    node = Node("other", None, [node, *self.arguments()])
                elif self.take("["):
                    node = Node("other", None, [node, self.expression()])
                    self.need("]")
                else:
                    self.take("#")
                    if self.kind != "name":
                        raise ScriptError("member name wanted")
                    self.advance()
                    node = Node("other", None, [node])
            else:
                return node

    def primary(self) -> Node:
        if self.kind == "str":
            node = Node("str", self.token)
            self.advance()
            return node
        if self.kind == "num":
            node = Node("num", number_text(self.token))
            self.advance()
            return node
        if self.kind == "tick":
            return self.template()
        if self.kind == "name":
            word = self.token
            if word == "function" or word == "async" and self._ahead("function"):
                if word == "async":
                    self.advance()
                self.advance()
                return self.function(False)
            if word == "class":
                self.advance()
                return self.class_()
            if word == "new":
                self.advance()
                if self.take("."):
                    self.name()
                    return Node("other")
                callee = self.chain(self.primary(), False)
                return Node("new", None, [callee, *(self.arguments() if self.is_("(") else [])])
            if word in ("this", "super", "null", "true", "false", "import"):
                self.advance()
                return Node("other")
            return Node("name", self.name())
        if self.take("("):
            node = self.expression()
            self.need(")")
            return node
        if self.take("["):
            kids = []
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                kids.append(self.assignment())
                if not self.is_("]"):
                    self.need(",")
            return Node("array", None, kids)
        if self.is_("{"):
            return self.object_()
        if self.is_("/", "/=") and (m := _REGEX.match(self.text, self.start)):
            self.at = m.end()
            self.advance()
            return Node("other")
        raise ScriptError(f"unexpected {self.token or 'end'}")

    def object_(self) -> Node:
        """``value`` holds the keys of ``kids`` (None for those that aren't plain properties)."""
        self.need("{")
        keys: list[str | None] = []
        kids: list[Node] = []

        def add(key: str | None, *nodes: Node) -> None:
            keys.extend([key] * len(nodes))
            kids.extend(nodes)

        while not self.take("}"):
            if self.take("..."):
                add(None, self.assignment())
            else:
                accessor = self.is_("get", "set", "async") and not self._ahead("(", ":", ",", "}", "=")
                if accessor:
                    self.advance()
                star = self.take("*")
                plain = self.kind == "name" and self.token not in _RESERVED
                key, computed = self.key()
                add(None, *computed)
                if self.is_("("):
                    add(None, *self.parameters(), self.body())
                elif accessor or star:
                    raise ScriptError("property")
                elif self.take(":"):
                    add(key, self.assignment())
                elif plain and key is not None:
                    if self.take("="):  # only in a pattern
                        add(None, self.assignment())
                    else:
                        add(key, Node("name", key))
                else:
                    raise ScriptError("property")
            if not self.is_("}"):
                self.need(",")
        return Node("object", keys, kids)

    def template(self) -> Node:
        """At a back tick; the current token after it is what follows."""
        parts, kids, text = [], [], self.text
        i = begin = self.at
        while True:
            if i >= len(text):
                raise ScriptError("template")
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                parts.append(_unescape(text[begin:i]))
                self.at = i + 1
                self.advance()
                return Node("template", parts, kids)
            elif text.startswith("${", i):
                parts.append(_unescape(text[begin:i]))
                self.at = i + 2
                self.advance()
                kids.append(self.expression())
                if not self.is_("}"):
                    raise ScriptError("template")
                i = begin = self.start + 1
            else:
                i += 1


def number_text(token: str) -> str:
    """A number as a script writes it in text: whole ones without a point, others as short as possible, no exponent."""
    digits = token.replace("_", "").rstrip("n") if not token[:2].lower() == "0x" else token.replace("_", "").rstrip("n")
    try:
        if digits[:2].lower() in ("0x", "0o", "0b"):
            return str(int(digits, 0))
        value = float(digits)
    except ValueError as e:
        raise ScriptError("number") from e
    if value == int(value) if abs(value) < 1e300 else False:
        return str(int(value))
    text = repr(value)
    if "e" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f") if abs(value) != float("inf") else text
    return text


def parse_script(text: str) -> Node:
    """The tree of a script; :class:`ScriptError` if it is none, or nests too deeply."""
    try:
        return Parser(text).program()
    except RecursionError as e:
        raise ScriptError("too deep") from e

"""Recursive descent with binding powers; keywords are recognised by place."""

from __future__ import annotations

from ..errors import VtlSyntaxError
from . import nodes as N
from .lexer import Token, tokens

POWERS = {
    "or": 1, "xor": 1, "and": 2, "in": 3, "not_in": 3,
    "=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4,
    "+": 5, "-": 5, "||": 5, "*": 6, "/": 6,
}
UNARY = 7
CLAUSES = {"filter", "calc", "keep", "drop", "rename", "aggr", "pivot", "unpivot", "customPivot", "sub", "apply"}
JOINS = {"inner_join", "left_join", "full_join", "cross_join"}
MODES = {"non_null", "non_zero", "partial_null", "partial_zero", "always_null", "always_zero"}
TYPES = {"string", "integer", "number", "boolean", "date", "duration", "time_period", "time", "scalar", "dataset", "component", "measure", "identifier", "attribute"}
WORDS = {"then", "else", "when", "and", "or", "xor", "in", "not_in", "as", "using", "group", "having", "over", "errorcode", "errorlevel", "imbalance", "is", "end", "order", "partition"}


class Parser:
    def __init__(self, script: str):
        self.tokens, self.at = tokens(script), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, expected: str) -> VtlSyntaxError:
        t = self.now
        return VtlSyntaxError(f"expected {expected}, found {t.text or 'end of script'!r}", t.pos)

    def sees(self, *texts: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return t.kind in ("op", "name") and t.text in texts

    def take(self, *texts: str) -> Token | None:
        if self.sees(*texts):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, *texts: str) -> Token:
        return self.take(*texts) or self._raise(" or ".join(repr(t) for t in texts))

    def _raise(self, expected: str):
        raise self.fail(expected)

    def name(self) -> str:
        t = self.now
        if t.kind not in ("name", "quoted"):
            raise self.fail("a name")
        self.at += 1
        return t.text

    def component(self) -> str:
        first = self.name()
        return f"{first}#{self.name()}" if self.take("#") else first

    def names(self) -> tuple[str, ...]:
        out = [self.component()]
        while self.take(","):
            out.append(self.component())
        return tuple(out)

    def separated(self, read):
        out = [read()]
        while self.take(","):
            out.append(read())
        return tuple(out)

    # ---- statements

    def script(self) -> list[N.Statement]:
        out = []
        while self.now.kind != "end":
            out.append(self.statement())
            if not self.take(";") and self.now.kind != "end":
                raise self.fail("';'")
        return out

    def statement(self) -> N.Statement:
        pos = self.now.pos
        if self.sees("define") and not self.sees(":=", "<-", ahead=1):
            self.at += 1
            if self.take("datapoint"):
                return self.datapoint_ruleset(pos)
            if self.take("hierarchical"):
                return self.hierarchical_ruleset(pos)
            self.need("operator")
            return self.operator(pos)
        name = self.name()
        op = self.need(":=", "<-")
        return N.Assign(pos, name, self.expr(), op.text == "<-")

    def signature(self) -> tuple[bool, tuple[tuple[str, str], ...]]:
        domain = self.need("variable", "valuedomain").text == "valuedomain"

        def item():
            name = self.name()
            return name, (self.name() if self.take("as") else name)

        return domain, self.separated(item)

    def error_fields(self) -> tuple[object, object]:
        code = self.constant() if self.take("errorcode") else None
        level = self.constant() if self.take("errorlevel") else None
        return code, level

    def constant(self) -> object:
        sign = -1 if self.take("-") else 1
        value = self.primary()
        if not isinstance(value, N.Constant):
            raise VtlSyntaxError("expected a constant", value.pos)
        return sign * value.value if sign < 0 else value.value

    def rule_name(self) -> str | None:
        if self.now.kind in ("name", "quoted") and self.sees(":", ahead=1):
            name = self.name()
            self.need(":")
            return name
        return None

    def rules(self, read) -> tuple:
        out = [read()]
        while self.take(";"):
            if self.sees("end"):
                break
            out.append(read())
        return tuple(out)

    def datapoint_ruleset(self, pos) -> N.DatapointRuleset:
        self.need("ruleset")
        name = self.name()
        self.need("(")
        domain, signature = self.signature()
        self.need(")")
        self.need("is")

        def rule():
            label, condition = self.rule_name(), None
            if self.take("when"):
                condition = self.expr()
                self.need("then")
            return N.Rule(label, condition, self.expr(), *self.error_fields())

        rules = self.rules(rule)
        self.need("end"), self.need("datapoint"), self.need("ruleset")
        return N.DatapointRuleset(pos, name, domain, signature, rules)

    def hierarchical_ruleset(self, pos) -> N.HierarchicalRuleset:
        self.need("ruleset")
        name = self.name()
        self.need("(")
        domain = self.need("variable", "valuedomain").text == "valuedomain"
        conditions = ()
        if self.take("condition"):
            def item():
                x = self.name()
                return x, (self.name() if self.take("as") else x)

            conditions = self.separated(item)
        self.need("rule")
        component = self.name()
        self.need(")")
        self.need("is")

        def code() -> str:
            if self.now.kind in ("name", "quoted", "string", "number"):
                self.at += 1
                return self.tokens[self.at - 1].text
            raise self.fail("a code")

        def rule():
            label, condition = self.rule_name(), None
            if self.take("when"):
                condition = self.expr()
                self.need("then")
            left = code()
            op = self.need("=", ">", ">=", "<", "<=").text
            sign = -1 if self.take("-") else (self.take("+") and 1) or 1
            items = [(sign, code())]
            while self.sees("+", "-"):
                items.append((-1 if self.need("+", "-").text == "-" else 1, code()))
            return N.CodeRule(label, condition, left, op, tuple(items), *self.error_fields())

        rules = self.rules(rule)
        self.need("end"), self.need("hierarchical"), self.need("ruleset")
        return N.HierarchicalRuleset(pos, name, domain, conditions, component, rules)

    def type_name(self) -> str:
        """A type with its optional constraint in braces, brackets or angle brackets, which is read over."""
        name = self.name()
        for left, right in (("<", ">"), ("{", "}"), ("[", "]")):
            if self.take(left):
                depth = 1
                while depth and self.now.kind != "end":
                    depth += {left: 1, right: -1}.get(self.now.text, 0)
                    self.at += 1
        return name

    def operator(self, pos) -> N.Operator:
        name = self.name()
        self.need("(")
        parameters = []
        while not self.take(")"):
            self.take(",")
            p = self.name()
            kind = None if self.sees(",", ")", "default") else self.type_name()
            parameters.append((p, kind, self.expr() if self.take("default") else None))
        returns = self.type_name() if self.take("returns") else None
        self.need("is")
        body = self.expr()
        self.need("end"), self.need("operator")
        return N.Operator(pos, name, tuple(parameters), returns, body)

    # ---- expressions

    def expr(self, least: int = 0) -> N.Node:
        pos = self.now.pos
        if self.sees("if") and not self.sees(",", ")", "]", ";", ahead=1):
            self.at += 1
            condition = self.expr()
            self.need("then")
            then = self.expr()
            self.need("else")
            return N.If(pos, condition, then, self.expr())
        if self.sees("case") and self.sees("when", ahead=1):
            self.at += 1
            branches = []
            while self.take("when"):
                condition = self.expr()
                self.need("then")
                branches.append((condition, self.expr()))
            self.need("else")
            return N.Case(pos, tuple(branches), self.expr())
        left = self.unary()
        while self.now.kind in ("op", "name") and POWERS.get(self.now.text, -1) > least:
            op = self.now
            self.at += 1
            if op.text in ("in", "not_in"):
                right = self.set_of() if self.sees("{") else N.Variable(self.now.pos, self.name())
            else:
                right = self.expr(POWERS[op.text])
            left = N.Binary(op.pos, op.text, left, right)
        return left

    def unary(self) -> N.Node:
        t = self.now
        if self.take("+", "-", "not"):
            operand = self.unary()
            if t.text == "-" and isinstance(operand, N.Constant) and operand.type in ("integer", "number"):
                return N.Constant(t.pos, -operand.value, operand.type)
            return N.Unary(t.pos, t.text, operand)
        return self.postfix(self.primary())

    def postfix(self, x: N.Node) -> N.Node:
        while True:
            if self.take("#"):
                x = N.Membership(x.pos, x, self.name())
            elif self.take("["):
                kind = self.need(*CLAUSES).text
                x = N.Clause(x.pos, x, kind, self.clause(kind))
                self.need("]")
            else:
                return x

    def set_of(self) -> N.SetOf:
        pos = self.need("{").pos
        items = self.separated(self.unary)
        self.need("}")
        return N.SetOf(pos, items)

    def primary(self) -> N.Node:
        t = self.now
        if t.kind == "number":
            self.at += 1
            whole = t.text.isdigit()
            return N.Constant(t.pos, int(t.text) if whole else float(t.text), "integer" if whole else "number")
        if t.kind == "string":
            self.at += 1
            return N.Constant(t.pos, t.text, "string")
        if self.take("("):
            inside = self.expr()
            self.need(")")
            return inside
        if self.sees("{"):
            return self.set_of()
        if t.kind == "name" and t.text in ("true", "false"):
            self.at += 1
            return N.Constant(t.pos, t.text == "true", "boolean")
        if t.kind == "name" and t.text == "null":
            self.at += 1
            return N.Constant(t.pos, None, "null")
        if t.kind == "name" and t.text == "_":
            self.at += 1
            return N.Omitted(t.pos)
        if t.kind in ("name", "quoted"):
            if t.kind == "name" and t.text in WORDS:
                raise self.fail("an expression")
            name = self.name()
            if t.kind == "name" and self.sees("("):
                return self.call(t, name)
            return N.Variable(t.pos, name)
        raise self.fail("an expression")

    def call(self, t: Token, name: str) -> N.Node:
        self.need("(")
        if name in JOINS:
            return self.join(t.pos, name)
        if name == "cast":
            operand = self.expr()
            self.need(",")
            kind = self.type_name()
            mask = self.constant() if self.take(",") else None
            self.need(")")
            return N.Cast(t.pos, operand, kind, mask)
        args, options = [], {}
        while not self.take(")"):
            if self.now.kind == "end":
                raise self.fail("')'")
            if self.take(","):
                continue
            if self.sees("over"):
                options["over"] = self.window()
            elif self.sees("group") and self.sees("by", "except", "all", ahead=1):
                options["grouping"] = self.grouping()
            elif self.take("having"):
                options["having"] = self.expr()
            elif args and self.sees("errorcode", "errorlevel"):
                options["code"], options["level"] = self.error_fields()
            elif args and self.take("imbalance"):
                options["imbalance"] = self.expr()
            elif args and self.sees("invalid", "all", "all_measures", "single", "computed", "first", "last") and self.sees(")", ",", ahead=1):
                options["output"] = self.name()
            elif args and self.take("components"):
                options["components"] = self.names()
            elif args and self.take("condition"):
                options["condition"] = self.names()
            elif args and self.sees("rule") and not self.sees(",", ")", ahead=1) and "rule" not in options and self.tokens[self.at + 1].kind in ("name", "quoted") and not self.sees(*MODES, ahead=1):
                self.at += 1
                options["rule"] = self.name()
            elif args and self.sees(*MODES):
                options["mode"] = self.name()
            elif args and name in ("check_hierarchy", "hierarchy") and self.sees("dataset", "dataset_priority", "rule", "rule_priority"):
                options["input"] = self.name()
            elif name == "eval" and self.take("language"):
                options["language"] = self.constant()
            elif name == "eval" and self.take("returns"):
                options["returns"] = self.type_name()
            else:
                args.append(self.expr())
        return N.Call(t.pos, name, tuple(args), options)

    def window(self) -> N.Window:
        self.need("over")
        self.need("(")
        partition, order, frame = (), (), None
        if self.take("partition"):
            self.need("by")
            partition = self.names()
        if self.take("order"):
            self.need("by")

            def item():
                name = self.component()
                return name, (self.take("asc", "desc") or Token("", "asc", (0, 0))).text == "asc"

            order = self.separated(item)
        if self.sees("data", "range"):
            kind = "rows" if self.take("data") else "range"
            self.need("points") if kind == "rows" else self.need("range")
            self.need("between")
            low = self.bound()
            self.need("and")
            frame = (kind, low, self.bound())
        self.need(")")
        return N.Window(partition, order, frame)

    def bound(self) -> int | str:
        if self.take("current"):
            self.need("data")
            self.need("point")
            return 0
        if self.take("unbounded"):
            return "-" if self.need("preceding", "following").text == "preceding" else "+"
        n = self.constant()
        return -n if self.need("preceding", "following").text == "preceding" else n

    def grouping(self) -> N.Grouping:
        self.need("group")
        kind = self.need("by", "except", "all").text
        if kind == "all":
            return N.Grouping("all", key=self.expr())
        names, period = [], None
        while True:
            if self.sees("time_agg") and self.sees("(", ahead=1):
                call = self.primary()
                period = call.args[0].value
            else:
                names.append(self.component())
            if not self.sees(",") or not self.tokens[self.at + 1].kind in ("name", "quoted"):
                break
            self.at += 1
        return N.Grouping(kind, tuple(names), period=period)

    def role(self) -> str | None:
        if self.sees("viral") and self.sees("attribute", ahead=1):
            self.at += 2
            return "VIRALATTRIBUTE"
        if self.sees("identifier", "measure", "attribute", "component") and not self.sees(":=", ahead=1):
            word = self.name()
            return None if word == "component" else word.upper()
        return None

    def calc_item(self) -> N.CalcItem:
        role = self.role()
        name = self.component()
        self.need(":=")
        return N.CalcItem(role, name, self.expr())

    def clause(self, kind: str):
        if kind in ("filter", "apply"):
            return self.expr()
        if kind == "calc":
            return self.separated(self.calc_item)
        if kind in ("keep", "drop"):
            return self.names()
        if kind == "rename":
            def pair():
                a = self.component()
                self.need("to")
                return a, self.component()

            return self.separated(pair)
        if kind == "aggr":
            items = self.separated(self.calc_item)
            grouping = self.grouping() if self.sees("group") else None
            return N.Aggregation(items, grouping, self.expr() if self.take("having") else None)
        if kind in ("pivot", "unpivot", "customPivot"):
            a = self.component()
            self.need(",")
            b = self.component()
            values = self.separated(self.constant) if kind == "customPivot" and self.need("in") else ()
            return a, b, values

        def equal():
            a = self.component()
            self.need("=")
            return a, self.unary()

        return self.separated(equal)

    def join(self, pos, kind: str) -> N.Join:
        def operand():
            x = self.postfix(self.primary())
            return x, (self.name() if self.take("as") else None)

        operands = self.separated(operand)
        using = self.names() if self.take("using") else ()
        body = []
        while not self.take(")"):
            clause = self.need(*CLAUSES).text
            body.append((clause, self.clause(clause)))
        return N.Join(pos, kind, operands, using, tuple(body))


def parse(script: str) -> list[N.Statement]:
    return Parser(script).script()

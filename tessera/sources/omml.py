"""Office math to LaTeX."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_ACCENTS = dict(zip("̀́̂̃̄̅̆̇̈̊̌⃗⃛⃜⃖⃡", "grave acute hat tilde bar overline breve dot ddot mathring check vec dddot ddddot overleftarrow overleftrightarrow".split()))
_GROUPS = {"⏞": "overbrace", "⏟": "underbrace", "⏜": "overparen", "⏝": "underparen", "⎴": "overbracket", "⎵": "underbracket", "→": "overrightarrow", "←": "overleftarrow"}
_BIG = dict(zip("∑∏∐∫∬∭∮∯∰⋀⋁⋂⋃⨀⨁⨂⨆", "sum prod coprod int iint iiint oint oiint oiiint bigwedge bigvee bigcap bigcup bigodot bigoplus bigotimes bigsqcup".split()))
_GREEK = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho varsigma sigma tau upsilon phi chi psi omega".split()
_SYMBOLS = {chr(0x3B1 + k): name for k, name in enumerate(_GREEK)} | dict(zip("ΓΔΘΛΞΠΣΦΨΩ", "Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega".split()))
_SYMBOLS |= dict(zip("×÷±∓·∗≤≥≠≈≡∼∝∞∂∇∈∉⊂⊃⊆⊇∪∩∅∀∃→←↔⇒⇐⇔…⋯∠⊥∥√′°∧∨¬⊕⊗∘", "times div pm mp cdot ast leq geq neq approx equiv sim propto infty partial nabla in notin subset supset subseteq supseteq cup cap emptyset forall exists rightarrow leftarrow leftrightarrow Rightarrow Leftarrow Leftrightarrow ldots cdots angle perp parallel surd prime circ wedge vee neg oplus otimes circ".split()))
_FUNCTIONS = set("sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln exp lim min max sup inf det gcd arg deg dim hom ker Pr".split())
_LIMITS = {"lim", "min", "max", "sup", "inf"}
_SCRIPTS = {"script": "mathcal", "fraktur": "mathfrak", "double-struck": "mathbb", "sans-serif": "mathsf", "monospace": "mathtt"}


def escape_latex(text: str) -> str:
    """Specials get a backslash unless they have one."""
    return re.sub(r"(?<!\\)([{}_^#&$%])", r"\\\1", text)


def _prop(node: ET.Element, pr: str, name: str) -> str | None:
    """Value of a property; "" for one present without a value; None where absent."""
    found = node.find(f"{M}{pr}/{M}{name}")
    return None if found is None else found.get(f"{M}val", "")


class _Converter:
    def all(self, node: ET.Element | None) -> str:
        return "" if node is None else "".join(self.one(child) for child in node)

    def part(self, node: ET.Element, name: str) -> str:
        return self.all(node.find(M + name))

    def one(self, node: ET.Element) -> str:
        name = node.tag.removeprefix(M)
        handler = getattr(self, "do_" + name, None)
        if handler:
            return handler(node)
        if name in ("oMath", "oMathPara", "box", "sSub", "sSup", "sSubSup", "num", "den", "deg", "e", "ins", "smartTag"):
            return self.all(node)
        return ""

    def do_r(self, node):
        text = "".join(t.text or "" for t in node.iter(M + "t"))
        text = "".join(f"\\{_SYMBOLS[c]} " if c in _SYMBOLS else c for c in escape_latex(text))
        style = _SCRIPTS.get(_prop(node, "rPr", "scr") or "")
        return f"\\{style}{{{text}}}" if style and text else text

    def do_f(self, node):
        top, bottom = self.part(node, "num"), self.part(node, "den")
        kind = _prop(node, "fPr", "type")
        return {"lin": f"{{{top}}}/{{{bottom}}}", "skw": f"^{{{top}}}/_{{{bottom}}}", "noBar": f"\\genfrac{{}}{{}}{{0pt}}{{}}{{{top}}}{{{bottom}}}"}.get(kind or "", f"\\frac{{{top}}}{{{bottom}}}")

    def do_sub(self, node):
        return f"_{{{self.all(node)}}}"

    def do_sup(self, node):
        return f"^{{{self.all(node)}}}"

    def do_rad(self, node):
        degree, inner = self.part(node, "deg"), self.part(node, "e")
        return f"\\sqrt[{degree}]{{{inner}}}" if degree else f"\\sqrt{{{inner}}}"

    def do_acc(self, node):
        sign = _prop(node, "accPr", "chr")
        return f"\\{_ACCENTS.get('̂' if sign is None else sign, 'hat')}{{{self.part(node, 'e')}}}"

    def do_bar(self, node):
        line = "overline" if _prop(node, "barPr", "pos") == "top" else "underline"
        return f"\\{line}{{{self.part(node, 'e')}}}"

    def do_d(self, node):
        inner = [self.all(e) for e in node.findall(M + "e")]
        if node.find(M + "dPr") is None:
            return "".join(inner)
        left, right, between = (_prop(node, "dPr", x) for x in ("begChr", "endChr", "sepChr"))
        side = lambda given, usual: "." if given == "" else escape_latex(usual if given is None else given)
        return f"\\left{side(left, '(')}{(between or '|').join(inner)}\\right{side(right, ')')}"

    def do_func(self, node):
        name, arg = "".join(map(self.one, node.findall(M + "fName"))), self.part(node, "e")
        return f"{name}({arg})"

    def do_fName(self, node):
        text = self.all(node).strip()
        return f"\\{text}" if text in _FUNCTIONS else text

    def do_groupChr(self, node):
        sign = _prop(node, "groupChrPr", "chr")
        inner = self.part(node, "e")
        command = _GROUPS.get("⏟" if sign is None else sign)
        return f"\\{command}{{{inner}}}" if command else inner

    def do_eqArr(self, node):
        lines = []
        for e in node.findall(M + "e"):
            line = self.all(e)
            found = re.match(r"(.*)\\#\((.*)\)$", line)
            lines.append(f"{found[1]}\\tag{{{found[2]}}}" if found else line)
        return "\\begin{array}{c}" + "\\\\".join(lines) + "\\end{array}"

    def do_limLow(self, node):
        base, below = self.part(node, "e"), self.part(node, "lim")
        word = base.strip().lstrip("\\")
        return f"\\{word}_{{{self._arrow(below)}}}" if word in _LIMITS else f"\\underset{{{below}}}{{{base}}}"

    def do_limUpp(self, node):
        return f"\\overset{{{self.part(node, 'lim')}}}{{{self.part(node, 'e')}}}"

    def do_lim(self, node):
        return self._arrow(self.all(node))

    @staticmethod
    def _arrow(text: str) -> str:
        return text.replace("\\rightarrow", "\\to")

    def do_borderBox(self, node):
        return f"\\boxed{{{self.part(node, 'e')}}}"

    def do_sPre(self, node):
        return f"{{}}_{{{self.part(node, 'sub')}}}^{{{self.part(node, 'sup')}}}{self.part(node, 'e')}"

    def do_m(self, node):
        return "\\begin{matrix}" + "\\\\".join(self.do_mr(r) for r in node.findall(M + "mr")) + "\\end{matrix}"

    def do_mr(self, node):
        return "&".join(self.all(e) for e in node.findall(M + "e"))

    def do_nary(self, node):
        sign = _prop(node, "naryPr", "chr")
        out = "\\" + _BIG.get("∫" if sign is None else sign, "int")
        for mark, part in (("_", "sub"), ("^", "sup")):
            text = self.part(node, part)
            out += f"{mark}{{{text}}}" if text else ""
        return out + self.part(node, "e")


def to_latex(math: ET.Element | str) -> str:
    """LaTeX of an oMath element."""
    return _Converter().one(ET.fromstring(math) if isinstance(math, str) else math)

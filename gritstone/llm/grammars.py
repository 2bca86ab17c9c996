"""Lexers and parsing-expression grammars of eight languages.

Binary operators are one flat list: precedence does not decide whether a text is valid. Names that are keywords only in some
places are tokens of their own and allowed as names by the ``Name`` rules.
"""

from __future__ import annotations

import re
import sys
from functools import cache

from gritstone.functions import lexing

from .peg import BAD, DEDENT, END, INDENT, NL, NUM, STR, TPL, Grammar, Kinds

# ---------------------------------------------------------------------------------------------------------------- lexing

_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_BLOCK, _LINE = r"/\*(?:[^*]|\*(?!/))*\*/", r"//[^\n]*"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)"
_IDENT = r"[^\W\d]\w*"


def _template(depth: int) -> str:
    """A template literal, with templates in its substitutions down to ``depth``."""
    inner = f"|{_template(depth - 1)}" if depth else ""
    braces = r"\{(?:[^{}`]|\{(?:[^{}`]|\{[^{}]*\}" + inner + r")*\}" + inner + r")*\}"
    return r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$" + braces + r")*`"


_TEMPLATE = _template(2)
_REGEX = r"(?:(?<=[(,=:\[!&|?{};+~>])[ \t\n]*|(?<=\breturn)[ \t]*|(?<=\btypeof)[ \t]*|(?<=\bcase)[ \t]*)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"


_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")


def _flat_templates(pattern: re.Pattern, text: str) -> str:
    """``text`` with what stands in its template literals blanked out, however deep they nest; lines and places stay. ``pattern``
    finds the tokens between them."""
    out: list[str] = []
    kept, at, start = 0, 0, 0
    open_braces: list[int] = []  # of each template that is open, the braces open in its substitution; -1 in its text
    while at < len(text):
        if open_braces and open_braces[-1] < 0:
            at = _TEMPLATE_TEXT.match(text, at).end()
            if text.startswith("${", at):
                open_braces[-1] = 0
                at += 2
                continue
            open_braces.pop()
            at += 1
            if not open_braces and at <= len(text):
                out += [text[kept : start + 1], re.sub(r"[^\n]", " ", text[start + 1 : at - 1]), "`"]
                kept = at
            continue
        m = pattern.search(text, at)
        if m is None:
            break
        if m[0][0] == "`":
            if not open_braces:
                start = m.start()
            open_braces.append(-1)
            at = m.start() + 1
            continue
        at = m.end()
        if open_braces and m[0] == "{":
            open_braces[-1] += 1
        elif open_braces and m[0] == "}":
            open_braces[-1] -= 1
    return "".join(out) + text[kept:]


def _operators(text: str) -> str:
    return "|".join(re.escape(op) for op in sorted((o for o in text.split() if not o[0].isalnum() and len(o) > 1), key=len, reverse=True)) or r"(?!)"


class Lexer:
    """Tokens of a language by one regular expression and a table of kinds."""

    def __init__(self, kinds: Kinds, operators: str, literals: str, comments: str, number: str = _NUMBER, suffix: str = "", ident: str = _IDENT, newline: bool = False, extra: str = ""):
        self.kinds, self.newline = kinds, newline
        # a plain word is the commonest token: tried first, unless what follows may make it the start of another
        word = r"""[^\W\d]\w*+(?!["'`#$?!:])"""
        parts = [word, comments, extra, literals, number + suffix, ident, _operators(operators), r"\n" if newline else "", r"[^\s]"]
        self.pattern = re.compile("|".join(p for p in parts if p), re.M)
        self.comment = re.compile(comments, re.M) if comments else None
        self.table: dict[str, str] = {}

    def kind(self, token: str) -> str:
        known = self.kinds.char.get(token)
        if known is not None:
            return known
        if token == "\n":
            return NL
        if token[0].isspace():
            token = token.strip() or token
        first = token[0]
        if self.comment and self.comment.fullmatch(token):
            return NL if self.newline and "\n" in token else ""
        return self.classify(token, first)

    def classify(self, token: str, first: str) -> str:
        if first.isalpha() or first == "_":
            return STR if token[-1] in "\"'" else "i"
        if first.isdigit() or (first == "." and len(token) > 1):
            return NUM
        if first == "`" and len(token) > 1:
            return TPL
        if first in "\"'/" and len(token) > 1:
            return STR
        return BAD

    def prepare(self, text: str) -> str:
        return text

    def kinds_of(self, text: str) -> str:
        text = self.prepare(text)
        table, out = self.table, []
        if len(table) > 300_000:
            table.clear()
        for token in self.pattern.findall(text):
            k = table.get(token)
            if k is None:
                k = self.kind(token)
                if len(token) < 60:
                    table[token] = k
            out.append(k)
        return "".join(out)

    def places(self, text: str) -> list[int]:
        """Where each character of ``kinds_of`` stands in the text."""
        return [m.start() for m in self.pattern.finditer(text) for _ in self.kind(m[0])]


class _TemplateLexer(Lexer):
    """As the pattern of a template literal goes down two levels only, texts in which one seems open are flattened first."""

    def kinds_of(self, text: str) -> str:
        kinds = super().kinds_of(text)
        return super().kinds_of(_flat_templates(self.pattern, text)) if BAD in kinds and "`" in text else kinds

    def places(self, text: str) -> list[int]:
        return super().places(_flat_templates(self.pattern, text) if BAD in super().kinds_of(text) and "`" in text else text)


_several = re.compile("\n\n+")

# ------------------------------------------------------------------------------------------------ JavaScript, TypeScript

_JS_WORDS = """break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch
 this throw try typeof var void while with yield let static async await of get set from as null true false enum
 type interface implements declare abstract readonly private protected public override accessor namespace module keyof unique infer is asserts satisfies"""
_JS_OPS = "=> ... ?. ?? ??= ** **= ++ -- && || &&= ||= == === != !== <= >= << <<= += -= *= /= %= &= |= ^= { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #"
_JS_NAME = "async of get set from as type interface implements declare abstract readonly private protected public override accessor namespace module keyof unique infer is asserts satisfies static let await yield"

_JS = """
File <- Item* EOF
@ Item <- Import / Export / Stmt
EOS <- ';' / NL / &'}' / &EOF
Name <- ID / {%NAME%}
Import <- 'import' (STR / ImportClause 'from' STR) (('with' / 'as') Object)? EOS
ImportClause <- 'type' ImportNames &'from' / ImportNames
ImportNames <- '*' 'as' Name / NamedSet / Name (',' (NamedSet / '*' 'as' Name))?
NamedSet <- '{' (Named (',' Named)*)? ','? '}'
Named <- 'type' AnyName ('as' AnyName)? &{, }} / AnyName ('as' AnyName)?
AnyName <- ANYWORD / STR
Export <- 'export' ('default' (Func / Decorator* Class / TSDecl / Expr EOS) / '*' ('as' AnyName)? 'from' STR EOS / ('type')? NamedSet ('from' STR)? EOS / Decl / '=' Expr EOS)
Decl <- Decorator* Class / Func / VarDecl EOS / TSDecl
Decorator <- '@' (Name ('.' ANYWORD)* Args? / '(' Expr ')')
Block <- '{' Stmt* '}'
@ Stmt <- Block / VarDecl EOS / Decorator* Class / Func / TSDecl / If / For / While / Do / Return / Throw / Try / Switch / Jump / Label / ';' / ExprStmt
VarDecl <- {var let const} Binding (',' Binding)*
Binding <- Target '!'? TypeAnn? ('=' Assign)?
Target <- Name / ArrayPattern / ObjectPattern
ArrayPattern <- '[' ','* (PatternItem (','+ PatternItem)*)? ','* ']'
PatternItem <- '...' Target / Target ('=' Assign)?
ObjectPattern <- '{' (PatternProp (',' PatternProp)*)? ','? '}'
PatternProp <- '...' Target / PropName ':' Target ('=' Assign)? / Name ('=' Assign)?
Func <- 'async'? 'function' '*'? Name? TypeParams? Params TypeRet? (Block / FuncSig)
Params <- '(' (Param (',' Param)*)? ','? ')'
Param <- Decorator* (Access &(Name / '{' / '['))* '...'? (Target / 'this') '?'? TypeAnn? ('=' Assign)?
Access <- {public private protected readonly override}
Class <- Abstract? 'class' (!{extends implements} Name)? TypeParams? ('extends' Unary TypeArgs?)? Implements? '{' Member* '}'
@ Member <- ';' / 'static' Block / Decorator* MemberMod* (Accessor / Method / IndexSig / Field)
MemberMod <- {static public private protected readonly abstract override declare accessor} !{( = ; : ? ! < }}
Accessor <- {get set} PropName Params TypeRet? (Block / FuncSig)
Method <- ('async' !{( = ; : ? ! }})? '*'? PropName '?'? TypeParams? Params TypeRet? (Block / FuncSig)
Field <- PropName {? !}? TypeAnn? ('=' Assign)? EOS
PropName <- ANYWORD / STR / NUM / '[' Assign ']' / '#' ANYWORD
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' 'await'? '(' (({var let const} Target TypeAnn? / Postfix) {of in} Expr / (VarDecl / Expr)? ';' Expr? ';' Expr?) ')' Stmt
While <- 'while' '(' Expr ')' Stmt
Do <- 'do' Stmt 'while' '(' Expr ')' ';'?
Return <- 'return' (!NL Expr)? EOS
Throw <- 'throw' Expr EOS
Try <- 'try' Block ('catch' ('(' Target TypeAnn? ')')? Block ('finally' Block)? / 'finally' Block)
Switch <- 'switch' '(' Expr ')' '{' (('case' Expr / 'default') ':' Stmt*)* '}'
Jump <- {break continue} (!NL Name)? EOS / 'debugger' EOS
Label <- Name ':' Stmt
ExprStmt <- !{{ function class} Expr EOS
Expr <- Assign (',' Assign)*
Assign <- Arrow / 'yield' ('*' Assign / (!NL Assign)?) / Cond (AssignOp Assign)?
AssignOp <- {= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=} / '>' '>='/ '>' '>' '>='
Arrow <- 'async'? (Name / TypeParams? Params ArrowRet?) '=>' (Block / Assign)
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (BinOp Unary / TypeTest)*
BinOp <- '>' '>' '>' / '>' '>' / {+ - * / % ** == != === !== <= >= < > << && || ?? & | ^ instanceof in}
Unary <- {! ~ + - ++ -- typeof void delete await}* (Cast Unary / Postfix)
Postfix <- Primary Tail* (!NL {++ --})?
Tail <- '.' '#'? ANYWORD / '?.' ('#'? ANYWORD / '[' Expr ']' / Args) / '[' Expr ']' / Args / TypeArgs (Args / TPL) / TPL / NonNull
Args <- '(' (Arg (',' Arg)*)? ','? ')'
Arg <- '...'? Assign
Primary <- Func / NUM / STR / TPL / Array / Object / '(' Expr ')' / {this null true false super} / 'new' New / Class / 'import' ('.' ANYWORD)? / '#' ANYWORD / Name
New <- '.' ANYWORD / ('new' New / Primary) ('.' '#'? ANYWORD / '[' Expr ']')* TypeArgs? Args?
Array <- '[' ','* (Arg (','+ Arg)*)? ','* ']'
Object <- '{' (Prop (',' Prop)*)? ','? '}'
Prop <- '...' Assign / {get set} PropName Params TypeRet? Block / 'async'? '*'? PropName TypeParams? Params TypeRet? Block / PropName ':' Assign / Name ('=' Assign)?
"""

_JS_ONLY = """
TypeAnn <- '@' '@'
TypeRet <- '@' '@'
ArrowRet <- '@' '@'
TypeParams <- '@' '@'
TypeArgs <- '@' '@'
TypeTest <- '@' '@'
NonNull <- '@' '@'
Cast <- '@' '@'
Abstract <- '@' '@'
Implements <- '@' '@'
IndexSig <- '@' '@'
FuncSig <- '@' '@'
TSDecl <- '@' '@'
"""

_TS_ONLY = """
TypeAnn <- ':' Type
TypeRet <- ':' TypeResult
ArrowRet <- ':' TypeResult
TypeResult <- 'asserts'? (Name / 'this') 'is' Type / 'asserts' Name / Type
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- {const in}* Name ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* '>'
TypeTest <- !NL {as satisfies} ('const' / Type)
NonNull <- !NL '!'
Cast <- '<' Type '>'
Abstract <- 'abstract'
Implements <- 'implements' Type (',' Type)*
IndexSig <- '[' Name ':' Type ']' TypeAnn EOS
FuncSig <- EOS
TSDecl <- 'declare'? (Interface / Alias / Enum / Space) / 'declare' Decl / 'abstract' Class
Interface <- 'interface' Name TypeParams? ('extends' Type (',' Type)*)? ObjectType
Alias <- 'type' Name TypeParams? '=' Type EOS
Enum <- 'const'? 'enum' Name '{' (PropName ('=' Assign)? (',' PropName ('=' Assign)?)*)? ','? '}'
Space <- {namespace module} (STR / Name ('.' ANYWORD)*) '{' Item* '}'
Type <- Union ('extends' Union '?' Type ':' Type)?
Union <- {| &}? TypeOp ({| &} TypeOp)*
TypeOp <- {keyof typeof readonly unique infer}* TypePost
TypePost <- TypePrimary (!NL '[' Type? ']')*
TypePrimary <- FuncType / '(' Type ')' / ObjectType / TupleType / STR / TPL / '-'? NUM / {this null void true false} / 'new' FuncType / 'import' '(' STR ')' ('.' ANYWORD)* TypeArgs? / Name ('.' ANYWORD)* TypeArgs?
FuncType <- TypeParams? Params '=>' TypeResult
TupleType <- '[' (TupleItem (',' TupleItem)*)? ','? ']'
TupleItem <- '...'? (Name '?'? ':')? Type '?'?
ObjectType <- '{' (TypeMember ({; ,} / NL / &'}'))* '}'
TypeMember <- {readonly + -}* '[' Name ('in' Type ('as' Type)? / ':' Type) ']' ({+ -}? '?')? TypeAnn? / {readonly get set}? PropName '?'? (TypeParams? Params TypeRet? / TypeAnn)? / 'new'? TypeParams? Params TypeRet?
"""


@cache
def _javascript(typed: bool):
    kinds = Kinds(_JS_WORDS, _JS_OPS)
    lexer = _TemplateLexer(kinds, _JS_OPS, f"{_DQ}|{_SQ}|{_TEMPLATE}|{_REGEX}", rf"\A#![^\n]*|{_LINE}|{_BLOCK}", suffix="n?", ident=r"[^\W\d]\w*(?:\$[\w$]*)?|\$[\w$]*", newline=True)
    classify = lexer.classify
    lexer.classify = lambda token, first: "i" if first == "$" else classify(token, first)
    text = _JS.replace("%NAME%", _JS_NAME) + (_TS_ONLY if typed else _JS_ONLY)
    return lexer, Grammar(text, kinds, skip=True), lambda k: _several.sub(NL, k)


# ------------------------------------------------------------------------------------------------------------------ Java

_JAVA_WORDS = """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import
 instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while
 true false null record sealed permits var yield when module"""
_JAVA_OPS = "-> :: ... ++ -- && || == != <= >= << <<= += -= *= /= %= &= |= ^= { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @"
_JAVA = """
File <- (Annotation* 'package' QName ';')? Import* (TypeDecl / ';')* EOF
Import <- 'import' 'static'? QName ('.' '*')? ';' / ';'
Name <- ID / {record sealed permits var yield when module}
QName <- Name ('.' Name)*
@ TypeDecl <- Mod* (ClassD / EnumD / RecordD / InterfaceD)
Mod <- {public private protected static final abstract native synchronized transient volatile strictfp default} !{: ->} / 'sealed' &{class interface abstract public static} / Name '-' 'sealed' / Annotation
Annotation <- '@' QName ('(' (AnnPair (',' AnnPair)* / AnnValue)? ')')?
AnnPair <- Name '=' AnnValue
AnnValue <- Annotation / '{' (AnnValue (',' AnnValue)*)? ','? '}' / Cond
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annotation* Name ('extends' Type ('&' Type)*)?
Type <- Annotation* (Prim / Name TypeArgs? ('.' Annotation* Name TypeArgs?)*) Dims
Prim <- {boolean byte char double float int long short void}
Dims <- (Annotation* '[' ']')*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annotation* '?' ({extends super} Type)? / Type
Types <- Type (',' Type)*
ClassD <- 'class' Name TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? ClassBody
InterfaceD <- ('interface' / '@' 'interface') Name TypeParams? ('extends' Types)? ('permits' Types)? ClassBody
RecordD <- 'record' Name TypeParams? '(' (RecordPart (',' RecordPart)*)? ')' ('implements' Types)? ClassBody
RecordPart <- Annotation* Type '...'? Name
EnumD <- 'enum' Name ('implements' Types)? '{' (EnumItem (',' EnumItem)*)? ','? (';' Member*)? '}'
EnumItem <- Annotation* Name Args? ClassBody?
ClassBody <- '{' Member* '}'
@ Member <- ';' / 'static'? Block / TypeDecl / Mod* (MethodD / ConstructorD / Type Vars ';' / Name Block)
MethodD <- TypeParams? Type Name Params Dims Throws? ('default' AnnValue)? (Block / ';')
ConstructorD <- TypeParams? Name Params Throws? Block
Throws <- 'throws' Types
Params <- '(' (Param (',' Param)*)? ')'
Param <- ('final' / Annotation)* Type '...'? (Name '.')? (Name / 'this') Dims
Vars <- Var (',' Var)*
Var <- Name Dims ('=' (ArrayInit / Expr))?
ArrayInit <- '{' ((ArrayInit / Expr) (',' (ArrayInit / Expr))*)? ','? '}'
Block <- '{' Stmt* '}'
@ Stmt <- Block / ';' / If / For / While / Do / Try / SwitchS / Sync / Return / Throw / Jump / Assert / Yield / Label / LocalType / Local ';' / Expr ';'
LocalType <- &(('final' / 'abstract' / 'static' / Annotation)* {class enum record interface}) TypeDecl
Local <- ('final' / Annotation)* Type !'(' Vars
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' '(' (('final' / Annotation)* Type Name Dims ':' Expr / (Local / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)?) ')' Stmt
While <- 'while' '(' Expr ')' Stmt
Do <- 'do' Stmt 'while' '(' Expr ')' ';'
Try <- 'try' ('(' Resource (';' Resource)* ';'? ')' Block Catch* Finally? / Block (Catch+ Finally? / Finally))
Resource <- Local / Expr
Catch <- 'catch' '(' ('final' / Annotation)* Type ('|' Type)* Name ')' Block
Finally <- 'finally' Block
SwitchS <- Switch
Switch <- 'switch' '(' Expr ')' '{' ((Arm / Group)*) '}'
Arm <- Labels '->' (Block / Throw / Expr ';')
Group <- (Labels ':')+ Stmt*
Labels <- 'case' CaseItem (',' CaseItem)* ('when' Expr)? / 'default'
CaseItem <- 'default' / Pattern / Cond0
Cond0 <- Binary
Pattern <- 'final'? Type ('(' (Pattern (',' Pattern)*)? ')' Name? / Name) &{: -> , ) when && ;}
Sync <- 'synchronized' '(' Expr ')' Block
Return <- 'return' Expr? ';'
Throw <- 'throw' Expr ';'
Jump <- {break continue} Name? ';'
Assert <- 'assert' Expr (':' Expr)? ';'
Yield <- 'yield' !{= . ( [ ++ --} Expr ';' / 'yield' '(' Expr ')' ';'
Label <- Name ':' Stmt
Expr <- Lambda / Cond (AssignOp Expr)?
AssignOp <- {= += -= *= /= %= <<= &= |= ^=} / '>' '>=' / '>' '>' '>='
Lambda <- (Name / '(' (Name (',' Name)*)? ')' / Params) '->' (Block / Expr)
Cond <- Binary ('?' (Lambda / Expr) ':' (Lambda / Cond))?
Binary <- Unary (BinOp Unary / 'instanceof' 'final'? (Pattern / Type))*
BinOp <- '>' '>' '>' / '>' '>' / {+ - * / % == != <= >= < > << && || & | ^}
Unary <- {! ~ + - ++ --} Unary / '(' Type ('&' Type)* ')' (Lambda / &(ID / STR / NUM / {( ! ~ this super new true false null switch record var boolean int long double}) Unary) / '(' Prim Dims ')' Unary / Postfix
Postfix <- Primary Tail* {++ --}*
Tail <- '.' ('new' Creator / TypeArgs? (Name / {this super class}) ) / '[' Expr ']' / Args / '::' TypeArgs? (Name / 'new')
Args <- '(' (Expr (',' Expr)*)? ')'
Primary <- NUM / STR / {true false null this super} / 'new' Creator / Switch / '(' Expr ')' / Type Dims '::' (Name / 'new') / Prim Dims '.' 'class' / Name ('[' ']')+ '.' 'class' / Name
Creator <- TypeArgs? Annotation* (Prim / Name TypeArgs? ('.' Name TypeArgs?)*) (Dims0 ArrayInit / ('[' Expr ']')+ Dims / Args ClassBody?)
Dims0 <- ('[' ']')+
"""


@cache
def _java():
    kinds = Kinds(_JAVA_WORDS, _JAVA_OPS)
    lexer = Lexer(kinds, _JAVA_OPS, rf'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|{_DQ}|{_CHAR}', f"{_LINE}|{_BLOCK}", suffix="[lLfFdD]?", ident=r"[^\W\d][\w$]*|\$[\w$]*")
    return lexer, Grammar(_JAVA, kinds), None


# -------------------------------------------------------------------------------------------------------------------- Go

_GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_GO_OPS = ":= <- ... ++ -- && || == != <= >= << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= { } ( ) [ ] ; , < > + - * / % & | ^ ! = : . ~"
_GO = """
File <- ';'* 'package' ID ';' (Import ';')* (Top ';')* Top? EOF
Import <- 'import' ('(' (ImportSpec ';')* ImportSpec? ')' / ImportSpec)
ImportSpec <- {.}? ID? STR
@ Top <- FuncD / Decl
Decl <- 'const' (Group0 / ConstSpec) / 'var' (Group1 / VarSpec) / 'type' (Group2 / TypeSpec)
Group0 <- '(' (ConstSpec ';')* ConstSpec? ')'
Group1 <- '(' (VarSpec ';')* VarSpec? ')'
Group2 <- '(' (TypeSpec ';')* TypeSpec? ')'
Ids <- ID (',' ID)*
ConstSpec <- Ids (Type? '=' Exprs)?
VarSpec <- Ids (Type ('=' Exprs)? / '=' Exprs)
TypeSpec <- ID TypeParams? '='? Type
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- Ids Constraint
Constraint <- '~'? Type ('|' '~'? Type)*
FuncD <- 'func' Params? ID TypeParams? Params Result? Block?
Params <- '(' (ParamList ','?)? ')'
ParamList <- Param (',' Param)*
Param <- ID '...'? Type / '...'? Type
Result <- Params / Type
Type <- '(' Type ')' / '*' Type / '[' '...'? Expr? ']' Type / 'map' '[' Type ']' Type / '<-' 'chan' Type / 'chan' '<-'? Type / 'func' Params Result? / 'struct' '{' (FieldD ';')* FieldD? '}' / 'interface' '{' (IfaceD ';')* IfaceD? '}' / ID ('.' ID)? ('[' Type (',' Type)* ']')?
FieldD <- (Ids Type / '*'? ID ('.' ID)? ('[' Type (',' Type)* ']')?) STR?
IfaceD <- ID Params Result? / Constraint
Block <- '{' Stmts '}'
Stmts <- (Stmt? ';')* Stmt?
@ Stmt <- Decl / Block / If / For / Switch / Select / 'return' Exprs? / {break continue} ID? / 'goto' ID / 'fallthrough' / {go defer} Expr / Label / Simple
Label <- ID ':' (Stmt / &{; }})
Simple <- Exprs ({= := += -= *= /= %= &= |= ^= <<= >>= &^=} Exprs / {++ --} / '<-' Expr)?
SimpleN <- ExprsN ({= := += -= *= /= %= &= |= ^= <<= >>= &^=} ('range' ExprN / ExprsN) / {++ --} / '<-' ExprN)?
If <- 'if' (SimpleN? ';')? ExprN Block ('else' (If / Block))?
For <- 'for' ('range' ExprN / SimpleN? ';' ExprN? ';' SimpleN? / SimpleN)? Block
Switch <- 'switch' (SimpleN? ';')? (TypeSwitch / ExprN)? '{' Case* '}'
TypeSwitch <- (ID ':=')? PostfixN
Case <- ('case' CaseItem (',' CaseItem)* / 'default') ':' Stmts
CaseItem <- Expr / Type
Select <- 'select' '{' (('case' Simple / 'default') ':' Stmts)* '}'
Exprs <- Expr (',' Expr)*
ExprsN <- ExprN (',' ExprN)*
Expr <- Unary (BinOp Unary)*
ExprN <- UnaryN (BinOp UnaryN)*
BinOp <- {+ - * / % && || == != <= >= < > << >> &^ & | ^}
Unary <- {+ - ! ^ * & <-}* Postfix
UnaryN <- {+ - ! ^ * & <-}* PostfixN
Postfix <- Primary (Tail / Literal)*
PostfixN <- PrimaryN Tail*
Tail <- '.' (ID / '(' Type ')') / '.' '(' 'type' ')' / '[' (Expr? ':' Expr? (':' Expr)? / IndexItem (',' IndexItem)* ','?) ']' / Args
IndexItem <- Expr / Type
Args <- '(' (Arg (',' Arg)* '...'? ','?)? ')'
Arg <- Expr / Type
Primary <- NUM / STR / 'func' Params Result? Block / LitType Literal / '(' (Expr / Type) ')' / ID / Type &'('
PrimaryN <- NUM / STR / 'func' Params Result? Block / '[' '...'? Expr? ']' Type Literal / 'map' '[' Type ']' Type Literal / '(' (Expr / Type) ')' / ID / Type &'('
LitType <- '[' '...'? Expr? ']' Type / 'map' '[' Type ']' Type / 'struct' '{' (FieldD ';')* FieldD? '}' / ID ('.' ID)? ('[' Type (',' Type)* ']')?
Literal <- '{' (Element (',' Element)*)? ','? '}'
Element <- (Value ':')? Value
Value <- Literal / Expr
"""


def _go_semicolons(lexer: Lexer):
    c = lexer.kinds.char
    ends = re.escape("ins)]}" + "".join(c[w] for w in ("break", "continue", "fallthrough", "return", "++", "--")))
    after = re.compile(f"(?<=[{ends}])[\n]+")

    def apply(kinds: str) -> str:
        return after.sub(";", kinds + NL).replace(NL, "")

    return apply


@cache
def _go():
    kinds = Kinds(_GO_WORDS, _GO_OPS)
    lexer = Lexer(kinds, _GO_OPS, f"{_DQ}|`[^`]*`|{_CHAR}", f"{_LINE}|{_BLOCK}", suffix="i?", newline=True)
    classify = lexer.classify
    lexer.classify = lambda token, first: STR if first == "`" and len(token) > 1 else classify(token, first)
    return lexer, Grammar(_GO, kinds), _go_semicolons(lexer)


# ------------------------------------------------------------------------------------------------------------------ Rust

_RUST_WORDS = """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true
 type unsafe use where while union auto macro_rules"""
_RUST_OPS = ":: -> => ... ..= .. && || == != <= >= << += -= *= /= %= &= |= ^= <<= { } ( ) [ ] ; , < > + - * / % & | ^ ! = : . @ ? # $ _ ~"
_RUST = """
File <- InnerAttr* Item* EOF
InnerAttr <- '#' '!' Tree
Attr <- '#' Square
Square <- '[' Any* ']'
Any <- Tree / !{( ) [ ] { }} AnyToken
Tree <- '(' Any* ')' / '[' Any* ']' / '{' Any* '}'
AnyToken <- ANYWORD / NUM / STR / TPL / {:: -> => ... ..= .. && || == != <= >= << += -= *= /= %= &= |= ^= <<= ; , < > + - * / % & | ^ ! = : . @ ? # $ _ ~}
Name <- ID / {union auto}
@ Item <- Attr* (Vis? (Use / Mod / Fn / Struct / Enum / Union / Trait / Impl / TypeAlias / Const / Static / Extern) / MacroRules / MacroItem)
Vis <- 'pub' ('(' ('in' Path / {crate self super}) ')')?
Use <- 'use' UseTree ';'
UseTree <- '::'? (UseSeg '::')* ('{' (UseTree (',' UseTree)*)? ','? '}' / '*' / UseSeg ('as' (Name / '_'))?)
UseSeg <- Name / {crate self super Self}
Mod <- 'unsafe'? 'mod' Name (';' / '{' InnerAttr* Item* '}')
Extern <- 'unsafe'? 'extern' ('crate' (Name / 'self') ('as' (Name / '_'))? ';' / STR? '{' InnerAttr* Item* '}')
FnMods <- ({const async unsafe} / 'extern' STR?)*
Fn <- FnMods 'fn' Name Generics? '(' FnParams ')' ('->' Type)? Where? (Block / ';')
FnParams <- (FnParam (',' FnParam)*)? ','?
FnParam <- Attr* (SelfParam / '...' / PatternTop ':' ('...' / Type))
SelfParam <- ('&' TPL?)? 'mut'? 'self' (':' Type)?
Generics <- '<' (Generic (',' Generic)*)? ','? '>'
Generic <- Attr* (TPL (':' (TPL ('+' TPL)*)?)? / 'const' Name ':' Type ('=' (Block / Literal))? / Name (':' Bounds?)? ('=' Type)?)
Bounds <- Bound ('+' Bound)* '+'?
Bound <- TPL / '(' Bound ')' / ('?' / '~' 'const')? ForLife? Path
ForLife <- 'for' Generics
Where <- 'where' (WhereItem (',' WhereItem)*)? ','?
WhereItem <- TPL ':' (TPL ('+' TPL)*)? / ForLife? Type ':' Bounds?
Struct <- 'struct' Name Generics? (Where? '{' Fields '}' / '(' TupleFields ')' Where? ';' / Where? ';')
Union <- 'union' Name Generics? Where? '{' Fields '}'
Fields <- (Field (',' Field)*)? ','?
Field <- Attr* Vis? Name ':' Type
TupleFields <- (Attr* Vis? Type (',' Attr* Vis? Type)*)? ','?
Enum <- 'enum' Name Generics? Where? '{' (Variant (',' Variant)*)? ','? '}'
Variant <- Attr* Vis? Name ('{' Fields '}' / '(' TupleFields ')')? ('=' Expr)?
Trait <- 'unsafe'? 'auto'? 'trait' Name Generics? (':' Bounds?)? Where? '{' InnerAttr* Assoc* '}'
Impl <- 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? '{' InnerAttr* Assoc* '}'
@ Assoc <- Attr* (Vis? (Fn / TypeAlias / Const) / MacroItem)
TypeAlias <- 'type' Name Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';'
Const <- 'const' (Name / '_') ':' Type ('=' Expr)? ';'
Static <- 'static' 'mut'? Name ':' Type ('=' Expr)? ';'
MacroRules <- 'macro_rules' '!' Name ('{' Any* '}' / Tree ';')
MacroItem <- Path '!' ('{' Any* '}' / Tree ';')
Type <- TypeOne ('+' Bound)*
TypeOne <- '(' (Type (',' Type)*)? ','? ')' / '!' / '_' / '&' TPL? 'mut'? TypeOne / '&&' TPL? 'mut'? TypeOne / '*' {const mut} TypeOne / '[' Type (';' Expr)? ']' / ForLife? FnMods 'fn' '(' (FnTypeParam (',' FnTypeParam)*)? ','? ')' ('->' TypeOne)? / {impl dyn} Bounds / ForLife Path / '<' Type ('as' Path)? '>' ('::' PathSeg)+ / MacroType / Path
FnTypeParam <- ((Name / '_') ':')? Type / '...'
MacroType <- Path '!' Tree
Path <- '::'? PathSeg ('::' PathSeg)*
PathSeg <- (Name / {crate self super Self}) (GenericArgs / '::' GenericArgs / '(' (Type (',' Type)*)? ','? ')' ('->' TypeOne)?)?
GenericArgs <- '<' (GenericArg (',' GenericArg)*)? ','? '>'
GenericArg <- TPL / Name GenericArgs? {= :} (Type / Bounds) / Type / Literal / Block
ExprPath <- '<' Type ('as' Path)? '>' ('::' ExprSeg)+ / '::'? ExprSeg ('::' ExprSeg)*
ExprSeg <- (Name / {crate self super Self}) / GenericArgs
PatternTop <- '|'? Pattern ('|' Pattern)*
Pattern <- {ref mut}* Name '@' Pattern / '&' 'mut'? Pattern / '&&' 'mut'? Pattern / RangePat / '(' PatList ')' / '[' PatList ']' / '..' / '_' / MacroType / ExprPath ('{' (PatField (',' PatField)*)? ','? '}' / '(' PatList ')')? / {ref mut}+ Name / 'const' Block
RangePat <- PatBound (({..= ...} PatBound) / '..' PatBound?)? / {..= ..} PatBound
PatBound <- '-'? Literal / ExprPath &{..= ... ..}
PatList <- (PatternTop (',' PatternTop)*)? ','?
PatField <- Attr* ('..' / (Name / NUM) ':' PatternTop / {ref mut}* Name)
Block <- '{' InnerAttr* Stmt* Expr? '}'
@ Stmt <- ';' / Attr* (Let / BlockExpr !{. ?} / MacroStmt) / &(Attr* (Vis / {use mod struct enum trait impl type static extern macro_rules fn} / 'const' !{{ |} / 'unsafe' {fn impl trait extern} / 'async' 'fn')) Item / Attr* Expr ';'
Let <- 'let' PatternTop (':' Type)? ('=' Expr ('else' Block)?)? ';'
MacroStmt <- Path '!' '{' Any* '}' !{. ?}
BlockExpr <- (TPL ':')? ('if' If / 'match' Match / 'loop' Block / 'while' Cond Block / 'for' PatternTop 'in' ExprN Block / Block / 'unsafe' Block / 'async' 'move'? Block / 'const' Block)
If <- Cond Block ('else' ('if' If / Block))?
Cond <- CondItem ('&&' CondItem)*
CondItem <- 'let' PatternTop '=' UnaryN (CondOp UnaryN)* / ExprN
CondOp <- {+ - * / % == != <= >= < > << | ^ &}
Match <- ExprN '{' InnerAttr* Arm* '}'
Arm <- Attr* PatternTop ('if' Cond)? '=>' (BlockExpr ','? &({} | ( [ _ #} / ID / STR / NUM / TPL / {ref mut & - true false self Self crate super && .. ..= const ::}) / Expr (',' / &'}'))
Literal <- NUM / STR / {true false}
Expr <- {return break} TPL? Expr? / 'continue' TPL? / Closure / Range
ExprN <- {return break} TPL? ExprN? / 'continue' TPL? / Closure / RangeN
Closure <- {move async static}* ('||' / '|' (ClosureParam (',' ClosureParam)*)? ','? '|') ('->' TypeOne Block / Expr)
ClosureParam <- Attr* Pattern (':' Type)?
Range <- {.. ..=} Assign? / Assign ({.. ..=} Assign?)?
RangeN <- {.. ..=} AssignN? / AssignN ({.. ..=} AssignN?)?
AssignOp <- {= += -= *= /= %= &= |= ^= <<=} / '>' '>='
Assign <- Binary (AssignOp Expr)?
AssignN <- BinaryN (AssignOp ExprN)?
Binary <- Unary (BinOp (Closure / Unary) / 'as' TypeOne)*
BinaryN <- UnaryN (BinOp (Closure / UnaryN) / 'as' TypeOne)*
BinOp <- '>' '>' / {+ - * / % && || == != <= >= < > << & | ^}
Unary <- ({- ! *} / {& &&} ('mut' / {const} )? )* Postfix
UnaryN <- ({- ! *} / {& &&} 'mut'?)* PostfixN
Postfix <- Primary Tail*
PostfixN <- PrimaryN Tail*
Tail <- '?' / '.' ('await' / (Name / {self crate super}) ('::' GenericArgs)? / NUM) / '(' Args ')' / '[' Expr ']'
Args <- (Expr (',' Expr)*)? ','?
Primary <- Literal / BlockExpr / '(' (Expr (',' Expr)*)? ','? ')' / '[' (Expr ';' Expr / Args) ']' / {return break continue} / Macro / StructLit / ExprPath / '_'
PrimaryN <- Literal / BlockExprN / '(' (Expr (',' Expr)*)? ','? ')' / '[' (Expr ';' Expr / Args) ']' / Macro / ExprPath / '_'
BlockExprN <- &({if match loop while for unsafe async} / TPL ':' / '{') BlockExpr
Macro <- Path '!' Tree
StructLit <- ExprPath '{' (StructField (',' StructField)*)? (','? '..' Expr)? ','? '}'
StructField <- Attr* ((Name / NUM) ':' Expr / Name)
"""


@cache
def _rust():
    kinds = Kinds(_RUST_WORDS, _RUST_OPS)
    nested = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
    literals = rf'\bb?r(?:"[^"]*"|#"[\s\S]*?"#|##"[\s\S]*?"##|###"[\s\S]*?"###)|\b[bc]?"(?:[^"\\]|\\[\s\S])*"|"(?:[^"\\]|\\[\s\S])*"|b?{_CHAR}'
    number = r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?)"
    lexer = Lexer(kinds, _RUST_OPS, literals, f"{_LINE}|{nested}", number=number, suffix="(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?", ident=r"r#[^\W\d]\w*|[^\W\d]\w*", extra=r"'[^\W\d]\w*(?!')")
    classify = lexer.classify
    lexer.classify = lambda token, first: TPL if first == "'" and token[-1] != "'" and len(token) > 1 else classify(token, first)
    return lexer, Grammar(_RUST, kinds), None


# --------------------------------------------------------------------------------------------------------------------- C

_C_WORDS = """auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch
 typedef union unsigned void volatile while _Bool _Complex _Atomic _Noreturn _Static_assert _Alignas _Alignof _Generic _Thread_local bool __attribute__ __extension__ __inline __inline__ __restrict asm __asm__ typeof nullptr true false constexpr static_assert alignas"""
_C_OPS = "-> ++ -- && || == != <= >= << >> <<= >>= += -= *= /= %= &= |= ^= ... ## { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . #"
_C = """
File <- Ext* EOF
@ Ext <- ';' / 'extern' STR ('{' Ext* '}' / Ext) / FuncDef / Declaration / MacroCall / ID &{extern static const void char short int long float double unsigned signed struct union enum typedef inline} Ext
MacroCall <- ID '(' (AnyArg (',' AnyArg)*)? ')' (';' / Block)?
AnyArg <- Type / Assign
Attribute <- '__attribute__' '(' '(' (AttrItem (',' AttrItem)*)? ')' ')' / '[' '[' AttrItem (',' AttrItem)* ']' ']' / {asm __asm__} '(' STR+ ')'
AttrItem <- ({const} / ID) Args?
Spec <- {auto const extern inline register restrict static typedef volatile _Atomic _Noreturn _Thread_local __extension__ __inline __inline__ __restrict constexpr} / {_Alignas alignas} '(' (Type / Cond) ')' / Attribute
Basic <- {char double float int long short signed unsigned void _Bool _Complex bool}
Specs <- Spec* (Basic (Basic / Spec)* / Struct Spec* / Enum Spec* / 'typeof' '(' (Type / Expr) ')' Spec* / ID Spec*)
SpecsAny <- Specs / Spec+
Struct <- {struct union} Attribute* ID? ('{' (Field / ';')* '}' Attribute*)? 
Field <- Specs (FieldD (',' FieldD)*)? ';' / {_Static_assert static_assert} Args ';'
FieldD <- Declarator? ':' Cond / Declarator
Enum <- 'enum' Attribute* ID? (':' Basic+)? ('{' EnumItem (',' EnumItem)* ','? '}' Attribute*)?
EnumItem <- ID Attribute* ('=' Cond)?
Pointer <- ('*' Spec*)*
Declarator <- Attribute* Pointer Attribute* ('(' Declarator ')' / ID) Suffix* Attribute*
Suffix <- '[' {static const restrict volatile}* ('*' / Assign)? ']' / '(' Params? ')' (ID Args? &{; { , =})?
Params <- Param (',' Param)* (',' '...')? / ID (',' ID)*
Param <- Specs (Declarator / Abstract)? / '...'
Abstract <- Pointer ('(' Abstract ')' / &{[ (})? Suffix*
Type <- Specs Abstract?
FuncDef <- SpecsAny? Declarator (Declaration)* Block
Declaration <- SpecsAny (InitD (',' InitD)*)? ';' / {_Static_assert static_assert} Args ';'
InitD <- Declarator ('=' Init)?
Init <- '{' (InitItem (',' InitItem)*)? ','? '}' / Assign
InitItem <- (Designator+ '=' / ID ':')? Init
Designator <- '.' ID / '[' Cond ('...' Cond)? ']'
Block <- '{' Stmt* '}'
@ Stmt <- Block / ';' / If / For / While / Do / Switch / 'return' Init? ';' / 'goto' ID ';' / {break continue} ';' / Case / Label / Asm / Expr ';' / Declaration
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' '(' (Declaration / Expr? ';') Expr? ';' Expr? ')' Stmt
While <- 'while' '(' Expr ')' Stmt
Do <- 'do' Stmt 'while' '(' Expr ')' ';'
Switch <- 'switch' '(' Expr ')' Stmt
Case <- ('case' Cond ('...' Cond)? / 'default') ':' (Stmt / &'}')
Label <- ID ':' (Stmt / &'}')
Asm <- {asm __asm__} {volatile goto}* '(' (STR / {: ,} / '[' ID ']' / '(' Expr ')')* ')' ';'
Expr <- Assign (',' Assign)*
Assign <- Cond (AssignOp Assign)?
AssignOp <- {= += -= *= /= %= &= |= ^= <<= >>=}
Cond <- Binary ('?' Expr? ':' Cond)?
Binary <- Cast (BinOp Cast)*
BinOp <- {+ - * / % == != <= >= < > << >> && || & | ^}
Cast <- '(' Type ')' (Braces Tail* / Cast) / Unary
Braces <- '{' (InitItem (',' InitItem)*)? ','? '}'
Unary <- {sizeof _Alignof} '(' Type ')' / {sizeof _Alignof} Unary / {++ --} Unary / {& && * + - ~ ! __extension__} Cast / Primary Tail* 
Tail <- '[' Expr ']' / Args / {. ->} ID / {++ --}
Args <- '(' (AnyArgE (',' AnyArgE)*)? ')'
AnyArgE <- Assign / Type
Primary <- NUM / (STR / ID &STR)+ ID? / {true false nullptr} / '(' Block ')' / '(' Expr ')' / Generic / ID
Generic <- '_Generic' '(' Assign (',' (Type / 'default') ':' Assign)+ ')'
"""


@cache
def _c():
    kinds = Kinds(_C_WORDS, _C_OPS)
    directive = r"^[ \t]*#[ \t]*(?:include[ \t]*[<\"]|(?:define|undef|ifdef|ifndef)[ \t]+\w|(?:if|elif)\b|(?:else|endif)\b[ \t]*(?:/[/*].*)?$|(?:pragma|error|warning|line|embed|import|ident)\b|\n)(?:[^\n\\]|\\[\s\S])*"
    number = r"(?:0[xX][0-9a-fA-F']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?|0[bB][01]+|(?:[0-9][0-9']*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    lexer = Lexer(kinds, _C_OPS, rf"(?:\b(?:u8|[uUL]))?(?:{_DQ}|{_CHAR})", rf"//(?:[^\n\\]|\\[\s\S])*|{_BLOCK}", number=number, suffix="[uUlLfFzZ]*", extra=directive)
    classify = lexer.classify
    lexer.classify = lambda token, first: "" if token.lstrip()[0] == "#" and len(token) > 1 else classify(token, first)
    # what only a C++ compiler reads is blanked out, line by line
    guarded = re.compile(r"^[ \t]*#[ \t]*(?:ifdef[ \t]+__cplusplus|if[ \t]+defined[ \t(]*__cplusplus[ \t)]*)\b[^\n]*\n(?:(?![ \t]*#)[^\n]*\n)*", re.M)
    lexer.prepare = lambda text: guarded.sub(lambda m: "#ifdef __cplusplus\n" + "\n" * (m[0].count("\n") - 1), text) if "__cplusplus" in text else text
    return lexer, Grammar(_C, kinds), None


# ---------------------------------------------------------------------------------------------------------------- Python

_PY_WORDS = """False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return
 try while with yield match case type _"""
_PY_OPS = "-> := ** // << >> <= >= == != += -= *= /= //= %= @= &= |= ^= >>= <<= **= ... { } ( ) [ ] ; , < > + - * / % & | ^ ~ = : . @ !"
_PY = """
File <- NL* Stmt* EOF
@ Stmt <- Compound / Simple
Name <- ID / {match case type _}
Simple <- Small (';' Small)* ';'? NL
Small <- {pass break continue} / 'return' Stars? / 'raise' (Expr ('from' Expr)?)? / {global nonlocal} Name (',' Name)* / 'del' Targets / 'assert' Expr (',' Expr)? / Import / 'type' Name TypeParams? '=' Expr / Assignment
Assignment <- Targets ':' Expr ('=' (Yield / Stars))? / Targets AugOp (Yield / Stars) / (Targets '=')+ (Yield / Stars) / Stars / Yield
AugOp <- {+= -= *= /= //= %= @= &= |= ^= >>= <<= **=}
Targets <- Target (',' Target)* ','?
Target <- '*'? (Primary / '(' Targets? ')' / '[' Targets? ']')
Import <- 'import' Dotted ('as' Name)? (',' Dotted ('as' Name)?)* / 'from' ({. ...}* Dotted / {. ...}+) 'import' ('*' / '(' ImportAs (',' ImportAs)* ','? ')' / ImportAs (',' ImportAs)*)
Dotted <- Name ('.' Name)*
ImportAs <- Name ('as' Name)?
Compound <- Decorator* ('async'? Func / Class) / If / While / 'async'? (For / With) / Try / Match
Decorator <- '@' Named NL
Block <- NL INDENT Stmt+ DEDENT / Simple
Func <- 'def' Name TypeParams? '(' Params? ')' ('->' Expr)? ':' Block
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- {* **}? Name (':' Expr)? ('=' Expr)?
Params <- Param (',' Param)* ','?
Param <- '**' Name (':' Expr)? / '*' (Name (':' '*'? Expr)?)? / '/' / Name (':' Expr)? ('=' Expr)?
LambdaParams <- LambdaParam (',' LambdaParam)* ','?
LambdaParam <- '**' Name / '*' Name? / '/' / Name ('=' Expr)?
Class <- 'class' Name TypeParams? ('(' Args? ')')? ':' Block
If <- 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
While <- 'while' Named ':' Block ('else' ':' Block)?
For <- 'for' Targets 'in' Stars ':' Block ('else' ':' Block)?
With <- 'with' ('(' WithItem (',' WithItem)* ','? ')' &':' / WithItem (',' WithItem)*) ':' Block
WithItem <- Expr ('as' Target)?
Try <- 'try' ':' Block (('except' ('*'? Expr (',' Expr)* ('as' Name)?)? ':' Block)+ ('else' ':' Block)? ('finally' ':' Block)? / 'finally' ':' Block)
Match <- 'match' Stars ':' NL INDENT Case+ DEDENT
Case <- 'case' Patterns ('if' Named)? ':' Block
Patterns <- Pattern (',' Pattern)* ','?
Pattern <- '*' Name / PatternOr ('as' Name)?
PatternOr <- PatternOne ('|' PatternOne)*
PatternOne <- '-'? NUM ({+ -} NUM)? / STR+ / {None True False} / '(' Patterns? ')' / '[' Patterns? ']' / '{' (PatternPair (',' PatternPair)* ','?)? '}' / Dotted ('(' (PatternArg (',' PatternArg)* ','?)? ')')?
PatternPair <- '**' Name / PatternOne ':' Pattern
PatternArg <- Name '=' Pattern / Pattern
Stars <- Star (',' Star)* ','?
Star <- '*' Or / Named
Named <- Name ':=' Expr / Expr
Expr <- 'lambda' LambdaParams? ':' Expr / Or ('if' Or 'else' Expr)?
Yield <- 'yield' ('from' Expr / Stars)?
Or <- Unary (BinOp Unary)*
BinOp <- {or and in} / 'not' 'in' / 'is' 'not'? / {< > == >= <= != | ^ & << >> + - * / // % @ **}
Unary <- {not + - ~}* 'await'? Primary
Primary <- Atom Trailer*
Trailer <- '.' Name / '(' Args? ')' / '[' Slice (',' Slice)* ','? ']'
Slice <- Expr? ':' Expr? (':' Expr?)? / '*'? Named
Args <- Arg (',' Arg)* ','?
Arg <- {* **} Expr / Name '=' Expr / Named Comp?
Comp <- ('async'? 'for' Targets 'in' Or ('if' (Name ':=' Expr / Or))*)+
Atom <- Name / NUM / STR+ / {... None True False} / '(' (Yield / Star (Comp / (',' Star)* ','?))? ')' / '[' (Star (Comp / (',' Star)* ','?))? ']' / '{' (Pair (Comp / (',' Pair)* ','?) / Star (Comp / (',' Star)* ','?))? '}'
Pair <- '**' Or / Expr ':' Expr
"""


class _PythonLexer(Lexer):
    """Line ends, indents and dedents become kinds; inside brackets they are nothing."""

    def __init__(self):
        kinds = Kinds(_PY_WORDS, _PY_OPS)
        strings = rf'(?:\b[rRbBfFuU]{{1,2}})?(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\'|{_DQ}|{_SQ})'
        super().__init__(kinds, _PY_OPS, strings, r"", suffix="[jJ]?", extra=r"(?:[ \t\f]*(?:#[^\n]*)?\n)+[ \t\f]*|#[^\n]*|\\\n")

    def classify(self, token: str, first: str) -> str:
        if first == "\\" and len(token) > 1:
            return ""
        if first == "#":
            return ""
        return super().classify(token, first)

    def walk(self, text: str):
        """``(kinds, number of token)`` pairs in order."""
        table, depth, stack, started = self.table, 0, [0], False
        if len(table) > 300_000:
            table.clear()
        for n, token in enumerate(self.pattern.findall(text)):
            k = table.get(token)
            if k is None:
                k = NL if token[0] in " \t\f\n#" and "\n" in token else self.kind(token)
                if len(token) < 60:
                    table[token] = k
            if k == NL:
                if depth:
                    continue
                tail = token[token.rfind("\n") + 1 :].expandtabs(8)
                if started:
                    yield NL, n
                indent = len(tail)
                if indent > stack[-1]:
                    if started:
                        stack.append(indent)
                        yield INDENT, n
                    else:
                        yield BAD, n
                else:
                    while indent < stack[-1]:
                        stack.pop()
                        yield DEDENT, n
                    if indent != stack[-1]:
                        yield BAD, n
                started = False
            elif k:
                if k in "([{":
                    depth += 1
                elif k in ")]}":
                    depth = max(0, depth - 1)
                started = True
                yield k, n
        if started:
            yield NL, -1
        for _ in stack[1:]:
            yield DEDENT, -1

    def kinds_of(self, text: str) -> str:
        return "".join(k for k, _ in self.walk("\n" + text.rstrip(" \t\f\n") + "\n"))

    def places(self, text: str) -> list[int]:
        body = "\n" + text.rstrip(" \t\f\n") + "\n"
        starts = [m.start() for m in self.pattern.finditer(body)]
        return [max(0, starts[n] - 1) if n >= 0 else len(text) for k, n in self.walk(body)]


def _python_guess(grammar: Grammar, p: int) -> list[int]:
    """A statement ends with its line, or with the dedent of the block that follows it."""
    s, match, c = grammar.state[0], grammar.match, grammar.kinds.char
    i = p
    while True:
        i = s.find(NL, i)
        if i < 0:
            return []
        if s[i + 1] != INDENT:
            # a decorator's line belongs to what follows
            if s[p] == "@" and i < s.find(c["def"], p):
                i += 1
                continue
            return [i + 1]
        end = match.get(i + 1, -1)
        if end < 0:
            return []
        i = end + 1
        if s[i] not in (c["else"], c["elif"], c["except"], c["finally"]):
            return [i]


@cache
def _python():
    lexer = _PythonLexer()
    return lexer, Grammar(_PY, lexer.kinds, guess=_python_guess), None


# ------------------------------------------------------------------------------------------------------------------ Ruby

_RB_WORDS = """BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef
 unless until when while yield __method__ __FILE__ __LINE__ __dir__"""
_RB_OPS = "-> => == === != =~ !~ <=> <= >= && || << >> ** .. ... :: &. += -= *= /= %= **= &&= ||= |= &= ^= <<= >>= { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ = : . ?"
_RB = """
File <- Stmts EOF
T <- {;}
N <- (NL / ';')+
Stmts <- {;}* NL* (StmtN {;}* NL*)* Stmt?
@ StmtN <- Stmt (NL / ';')
Stmt <- StmtBase ({if unless while until rescue} Expr)*
StmtBase <- 'alias' DefName DefName / 'undef' DefName (',' DefName)* / {BEGIN END} '{' Stmts '}' / MultiAssign / Expr
MultiAssign <- Multi (',' Multi)+ ','? '=' W ArgList / Multi ',' '=' W ArgList / '*' Postfix '=' W ArgList
Multi <- '*' Postfix? / '(' Multi (',' Multi)* ')' / Postfix
W <- NL*
Expr <- NotExpr ({and or} W NotExpr)*
NotExpr <- 'not' NotExpr / Arg (('=>' / 'in') Arg)?
Arg <- Ternary (AssignOp W (Arg (',' W Splat)* / Splat (',' W Splat)*) ('rescue' Arg)?)?
AssignOp <- {= += -= *= /= %= **= &&= ||= |= &= ^= <<= >>=}
Splat <- {* **}? Ternary
Ternary <- Binary ('?' W Arg W ':' W Arg)?
Binary <- {.. ...} Unary / Unary (BinOp W Unary)* {.. ...}?
BinOp <- {+ - * / % ** == === != =~ !~ <=> <= >= < > << >> && || & | ^ .. ...}
Unary <- {! - + ~ & defined?}* Call
Call <- Postfix (CommandArgs DoBlock?)?
CommandArgs <- &(ID / STR / NUM / TPL / {-> :: nil true false self not defined? __method__ __FILE__ __LINE__ __dir__ super yield case if} / '[' / '!' / '*' ID / '&' STR / '&' ID / '**' ID) !{if unless while until rescue} ArgItem (',' W ArgItem)*
ArgList <- ArgItem (',' W ArgItem)*
ArgItem <- {* ** &} Arg? / TPL W (Arg)? / Arg (W '=>' W Arg)? / '...'
Postfix <- Primary Trailer*
Trailer <- {. &. ::} W (ANYWORD / '(' &ANYWORD / Operator) ParenArgs? / ParenArgs / '[' W (ArgList ','? W)? ']' / BraceBlock / DoBlock
Operator <- {+ - * / % == <=> << < > ! ~ & |} / '[' ']'
ParenArgs <- '(' W (ArgItem (W ',' W ArgItem)* W ','? W)? ')'
BraceBlock <- '{' BlockParams? Stmts '}'
DoBlock <- 'do' BlockParams? Body 'end'
BlockParams <- W '|' W (BlockParam (W ',' W BlockParam)* ','?)? (';' ID (',' ID)*)? W '|' / '||'
BlockParam <- {* **} ID? / '&' ID / TPL Ternary1? / ID ('=' Ternary1)? / '(' BlockParam (',' BlockParam)* ')'
Ternary1 <- NUM / STR / {nil true false} / '[' ']' / '{' '}' / '-' NUM / ID
Body <- Stmts Rescue* ('else' Stmts)? ('ensure' Stmts)?
Rescue <- 'rescue' (ArgList)? ('=>' Postfix)? ('then' / &NL / &';') Stmts
Primary <- NUM / STR+ / Symbol / Array / Hash / '(' Stmts ')' / Lambda / Def / Class / Module / If / Unless / While / Case / For / 'begin' Body 'end' / {return break next} (!{if unless while until rescue} ArgList)? / {redo retry self nil true false __method__ __FILE__ __LINE__ __dir__} / 'yield' (!{if unless [} (ParenArgs / CommandArgs))? / 'super' ParenArgs? / '::' ID / 'defined?' '(' Expr ')' / 'not' '(' Expr ')' / ID
Symbol <- ':' (STR / ANYWORD / Operator / {=== =~ ** >= <= !=})
Array <- '[' W (ArgItem (W ',' W ArgItem)* W ','? W)? ']'
Hash <- '{' W (Pair (W ',' W Pair)* W ','? W)? '}'
Pair <- '**' Arg / TPL W Arg? / STR ':' W Arg / Arg W '=>' W Arg
Lambda <- '->' ('(' W (Param (',' W Param)*)? W ')' / Param (',' Param)*)? (BraceBlock / DoBlock)
Def <- 'def' ((ID / 'self') '.')? DefName ('(' W (Param (W ',' W Param)*)? W ')' / Param (',' Param)*)? ('=' W Stmt / N? Body 'end')
DefName <- (ANYWORD) '=' &'(' / ANYWORD / Operator '='? / {=== =~ ** >= <= != !~ >> ^} / Symbol / TPL
Param <- {* **} (ID / 'nil')? / '&' ID? / TPL Ternary? / ID ('=' W Ternary)? / '(' Param (',' Param)* ')' / '...'
Class <- 'class' ('<<' Expr / Path ('<' Expr)?) N Body 'end' / 'class' Path ('<' Expr)? 'end'
Module <- 'module' Path N Body 'end'
Path <- '::'? ID ('::' ID)*
Then <- N? 'then' / N
If <- 'if' Expr Then Stmts ('elsif' Expr Then Stmts)* ('else' Stmts)? 'end'
Unless <- 'unless' Expr Then Stmts ('else' Stmts)? 'end'
While <- {while until} Expr ('do' / N) Stmts 'end' / {while until} Expr
Case <- 'case' Expr? N ('when' ArgItem (',' W ArgItem)* Then Stmts)+ ('else' Stmts)? 'end' / 'case' Expr N ('in' PatternTop ({if unless} Expr)? Then Stmts)+ ('else' Stmts)? 'end'
PatternTop <- Pattern (',' Pattern)*
Pattern <- PatternOne ('|' PatternOne)* ('=>' ID)?
PatternOne <- {* **} (ID / 'nil')? / TPL Pattern? / '[' W (PatternTop W)? ']' / '{' W (PatternTop W)? '}' / '^' (ID / '(' Expr ')') / Path ('(' (PatternTop)? ')' / '[' PatternTop ']')? / Binary
For <- 'for' Multi (',' Multi)* 'in' Expr ('do' / N) Stmts 'end'
"""


class _RubyLexer(Lexer):
    _HEREDOC = re.compile(r"<<(?:[~-](['\"`]?)([A-Za-z_]\w*)\1|(['\"`]?)([A-Z_][A-Z0-9_]*)\3)([^\n]*)\n(?:[^\n]*\n)*?[ \t]*(?:\2|\4)[ \t]*(?=\n|\Z)")

    def __init__(self):
        kinds = Kinds(_RB_WORDS, _RB_OPS)
        inside = r"#\{(?:[^{}\"]|\"[^\"\n]*\"|\{[^{}]*\})*\}"
        dq = rf'"(?:[^"\\#]|\\[\s\S]|#(?!\{{)|{inside})*"'
        percent = r"%[wWiIqQrx]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|\|[^|]*\|)"
        symbol = r":(?<!::)(?:\"(?:[^\"\\]|\\.)*\"|[^\W\d]\w*[?!]?)"
        literals = rf"{symbol}|{dq}|'(?:[^'\\]|\\[\s\S])*'|`[^`\n]*`|(?<=[\s(,=\[]){percent}|{_REGEX}"
        ident = r"(?:@@?|\$)[^\W\d]\w*|\$[0-9!@&~/\;,.<>:\"]|[^\W\d]\w*[?!]?:(?=[\s,)])(?!:)|[^\W\d]\w*(?:[?!](?![=~]))?"
        super().__init__(kinds, _RB_OPS, literals, r"^=begin\b[\s\S]*?^=end\b[^\n]*|#[^\n]*", suffix="r?i?", ident=ident, newline=True, extra=r"\\\n|^__END__$[\s\S]*")

    def kind(self, token: str) -> str:
        if token == "\\\n" or token.startswith("__END__"):
            return ""
        if token[-1] == ":" and len(token) > 1 and (token[0].isalpha() or token[0] == "_"):
            return TPL
        if token[0] in "@$" and len(token) > 1:
            return "i"
        if token[0] == ":" and len(token) > 2 - token[-1:].isalnum() and token != "::":
            return STR
        if token[0] == "%" and len(token) > 2:
            return STR
        return super().kind(token)

    def classify(self, token: str, first: str) -> str:
        if first == "`" and len(token) > 1:
            return STR
        if (first.isalpha() or first == "_") and token[-1] in "?!":
            return "i"
        return super().classify(token, first)

    def prepare(self, text: str) -> str:
        if "<<" in text:
            for _ in range(50):
                text, n = self._HEREDOC.subn(lambda m: '""' + m[5], text)
                if not n:
                    break
        return text


def _ruby_lines(lexer: Lexer):
    c = lexer.kinds.char
    ends = re.escape(",.([{+*/=&" + "".join(c[o] for o in ("=>", "==", "&&", "||", "<<", "+=", "-=", "||=", "&.", "::", "and", "or", "not", "!=", "=~")))
    after = re.compile(f"(?<=[{ends}])\n+")
    before = re.compile(f"\n+(?=[{re.escape('.' + c['&.'])}])")

    def apply(kinds: str) -> str:
        return before.sub("", after.sub("", _several.sub(NL, kinds)))

    return apply


def _ruby_guess(grammar: Grammar, p: int) -> list[int]:
    """A method ends before the next ``def`` that starts a line; any other statement with its line."""
    s, c = grammar.state[0], grammar.kinds.char
    i = s.find(NL if s[p] != c["def"] else NL + c["def"], p)
    return [i + 1] if i >= 0 else []


@cache
def _ruby():
    lexer = _RubyLexer()
    return lexer, Grammar(_RB, lexer.kinds, guess=_ruby_guess), _ruby_lines(lexer)


# --------------------------------------------------------------------------------------------------------------- parsing

_BUILD = {"javascript": lambda: _javascript(False), "typescript": lambda: _javascript(True), "java": _java, "go": _go, "rust": _rust, "c": _c, "python": _python, "ruby": _ruby}
_RUNS = re.compile(f"(?:[{NUM}{STR}],){{4,}}(?=[{NUM}{STR}])")
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}) |^(?:<{7}|={7}|>{7}|\|{7})$", re.M)


#: Frames that a parse may nest, some forty per level of brackets. They lie on the heap, about half a kilobyte each.
FRAMES = 1_000_000


def parser_of(language: str):
    """``(lexer, grammar, fix)`` of a language, built once per process."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    return _BUILD[language]()


def check_source(text: str | None, language: str) -> tuple[str, int, str] | None:
    """None if ``text`` is valid in ``language``, else ``(cause, line, message)`` of the furthest failure. A byte order mark, any
    line ends and a missing last one are no errors; an empty text is valid. Causes: ``merge conflict``, ``truncated``,
    ``unknown character``, ``unexpected token``."""
    text = lexing.clean(text)
    lexer, grammar, fix = parser_of(language)
    kinds = lexer.kinds_of(text)
    if fix:
        kinds = fix(kinds)
    if BAD not in kinds and grammar.parse(_RUNS.sub(f"{NUM},{NUM},", kinds)) is None:
        return None
    at, expected = grammar.parse(kinds) or (len(kinds), set())
    places = lexer.places(text) if not fix else []
    if fix:
        # where line ends were rewritten the place is that of the same share of tokens before it
        raw = lexer.kinds_of(text)
        seen = sum(1 for k in kinds[:at] if k not in (NL, ";"))
        starts = [p for p, k in zip(lexer.places(text), raw) if k not in (NL, ";")]
        place = starts[seen] if seen < len(starts) else len(text)
    else:
        place = places[at] if at < len(places) else len(text)
    line = text.count("\n", 0, place) + 1
    if _CONFLICT.search(text):
        cause = "merge conflict"
    elif at >= len(kinds.rstrip(NL + DEDENT + ";")):
        cause = "truncated"
    elif kinds[at : at + 1] == BAD:
        open_end = text[place : place + 1] in ("'", '"', "`", "/") and not text[place:].strip().count("\n")
        cause = "truncated" if open_end else "unknown character"
    else:
        cause = "unexpected token"
    found = grammar.kinds.name.get(kinds[at], kinds[at]) if at < len(kinds) else "end of text"
    wanted = ", ".join(sorted(repr(x) if x != END else "end of text" for x in expected)[:12])
    return cause, line, f"found {found!r}" + (f", expected {wanted}" if wanted else "")

"""Lexers and grammars of the languages that source files are written in."""

from __future__ import annotations

import re
import unicodedata

import regex

from .peg import NEWLINE, UNKNOWN, Grammar, Kinds

# --- ECMAScript and its typed superset -----------------------------------------------------------

_SCRIPT = r"""
module  <- (import / export / stmt)*
block   <- stmt*
word    <- ID / KEYWORD
name    <- ID / 'async' / 'of' / 'get' / 'set' / 'static' / 'from' / 'as' / MODIFIER / 'type' / 'interface' / 'namespace' / 'is' / 'enum' / TYPEOP
end     <- ';' / EOF
import  <- 'import' (STR / 'type'? !'from' clause 'from' STR) with? end / 'import' 'type' 'from' STR end
with    <- 'with' B:object
clause  <- name (',' (star / B:specs))? / star / B:specs
star    <- '*' 'as' name
specs   <- (spec (',' spec)* ','?)?
spec    <- 'type'? anyword !anyword ('as' anyword)? / anyword ('as' anyword)? / 'type'? anyword 'as' anyword
anyword <- name / KEYWORD / 'default' / STR
export  <- 'export' ('default' (func ';'? / abstract? klass ';'? / typed / one end) / decl / typed / '*' ('as' anyword)? 'from' STR end
        / 'type'? B:specs ('from' STR)? end / decor* abstract? klass ';'?)
abstract <- MODIFIER
decl    <- func ';'? / klass ';'? / vars end
vars    <- ('var' / 'let') var (',' var)* / 'const' cvar (',' cvar)*
var     <- name '!'? ann? ('=' one)? / pattern ann? '=' one
cvar    <- (name / pattern) '!'? ann? '=' one / name ann
target  <- name / pattern
pattern <- S:apat / B:opat
apat    <- (element? ',')* element?
element <- '...'? place ('=' one)?
opat    <- ((oprop (',' oprop)* ','?)?)
oprop   <- '...' place / key ':' place ('=' one)? / name ('=' one)?
place   <- pattern !POST / (name / P:expr / PRIVATE) post* TARGET / prim post+ TARGET
POST    <- '.' / '?.' / ANYP / ANYS
func    <- 'async'? 'function' '*'? name? tparams? P:params ann? (B:block / SIGNATURE)
klass   <- 'class' (!'extends' !IMPLEMENTS name)? tparams? ('extends' (name / P:expr) post* targs?)? implements? B:members
decor   <- '@' (P:paren / name ('.' word)* P:args?) ';'?
members <- (';' / member)*
member  <- decor* mod* ('static' B:block / '*'? key '?'? tparams? P:params ann? (B:block / SIGNATURE) / (INDEXER / key) ('?' / '!')? ann? ('=' one)? end) / 'static' B:block
mod     <- (MODIFIER / 'static' / 'async' / 'get' / 'set') &(name / KEYWORD / STR / NUM / ANYS / '*' / PRIVATE / 'default' / BIGNAME)
BIGNAME <- 'function' / 'class' / 'new' / 'delete' / 'import' / 'export' / 'in' / 'if' / 'for' / 'return' / 'with'
key     <- name / KEYWORD / reserved / STR / NUM / PRIVATE / S:index
reserved <- 'function' / 'class' / 'new' / 'delete' / 'import' / 'export' / 'in' / 'if' / 'for' / 'return' / 'with' / 'default' / 'var' / 'let' / 'const' / 'typeof' / 'void'
        / 'else' / 'while' / 'do' / 'switch' / 'case' / 'try' / 'catch' / 'finally' / 'throw' / 'break' / 'continue' / 'instanceof' / 'await' / 'yield' / 'extends'
params  <- (param (',' param)* ','?)?
param   <- decor* PARAMMOD '...'? target '?'? ann? ('=' one)?
PARAMMOD <- (MODIFIER &(name / ANYS / ANYB))*
stmt    <- (plain* 'if' P:expr nl)+ plain* core ('else' (plain / 'if' P:expr nl)* core)* / plain* core
nl      <- (';' &startish)?
startish <- name / KEYWORD / reserved / NUM / STR / RE / ANYB / ANYP / ANYS / '++' / '--' / '!' / '-' / '+'
plain   <- 'for' 'await'? P:for nl / 'while' P:expr nl / name ':' !':' 
for     <- (vars / expr)? ';' expr? ';' expr? / (('var' / 'let' / 'const') target / !'let' unary) ('of' / 'in') expr
core    <- ';' / decl / B:block / typed / 'do' (plain* (B:block / expr ';' / jump)) ';'? 'while' P:expr ';'? / 'switch' P:expr B:cases
        / 'try' B:block ('catch' P:params? B:block ('finally' B:block)? / 'finally' B:block) / jump / decor+ abstract? klass / !ANYB !'function' !'class' expr end
jump    <- 'return' expr? end / 'throw' expr end / ('break' / 'continue') name? end
cases   <- (('case' expr / 'default') ':' stmt*)*
expr    <- one (',' one)*
one     <- tern
ASSIGN  <- '=' !'=' / OPEQ / '>' '>' '>'? '='
arrow   <- 'async'? (name / tparams? P:params ann?) '=>'
tern    <- bin ('?' bin ('?' bin ':' bin)* ':' bin)*
operand <- arrow+ (B:block / unary) / unary
bin     <- operand (TARGET ASSIGN operand)* chain ('??' operand chain ('??' operand chain)* !LOGIC / LOGIC operand chain (LOGIC operand chain)* !'??')?
chain   <- (BIN operand / cast)*
LOGIC   <- '&&' / '||'
BIN     <- OP / '**' / '*' / '+' / '-' / '<' / '/' / '>' '='? / '>' '>' '>'? / 'in' / 'instanceof' / '|' / '&'
unary   <- 'yield' '*'? unary? / SIGN+ update !'**' / update
SIGN    <- '!' / '-' / '+' / UN / 'typeof' / 'void' / 'delete' / 'await'
update  <- ('new' / '++' / '--')* prim post* (TARGET ('++' / '--'))?
prim    <- func / klass / 'async'? name / NUM / STR / RE / P:expr / S:array / S:apat &ASSIGN / B:object / B:opat &ASSIGN / PRIVATE / 'import' (P:args / '.' word) / 'yield' / 'new' '.' name
post    <- '?.' (P:args / S:index / word / reserved / PRIVATE) / '.' (word / name / reserved / PRIVATE) / P:args / S:index / STR / targs &ANYP / NONNULL
args    <- (arg (',' arg)* ','?)?
arg     <- '...'? one
index   <- expr
array   <- (arg? ',')* arg?
object  <- (prop (',' prop)* ','?)?
prop    <- '...' one / ('async' / 'get' / 'set')? '*'? key tparams? P:params ann? B:block / key ':' one / name
"""

_PLAIN = r"""
ann <- NEVER
tparams <- NEVER
targs <- NEVER
cast <- NEVER
typed <- NEVER
implements <- NEVER
IMPLEMENTS <- NEVER
NONNULL <- NEVER
SIGNATURE <- NEVER
INDEXER <- NEVER
paren <- expr
"""

_TYPED = r"""
paren <- expr
IMPLEMENTS <- 'implements'
implements <- 'implements' type (',' type)*
NONNULL <- '!' !'='
SIGNATURE <- end
INDEXER <- S:indexer
indexer <- name ann
ann     <- ':' type
type    <- tunit (TBIN tunit)*
TBIN    <- '|' / '&' / 'extends' / '?' / ':' / 'is'
tpre    <- '|' / '&' / (TYPEOP / 'typeof' / 'new') &(name / KEYWORD / ANYP / ANYB / ANYS / STR)
tname   <- (name / KEYWORD / 'void' / NUM / '-' NUM / STR) ('.' word)*
tgroup  <- P:params / P:type / S:tuple / B:tobject / 'import' P:args
tunit   <- tpre* (ANGLES? P:params '=>' type / tname ANGLES? / ANGLES? tgroup) S:tindex*
ABIN    <- '|' / '&' / 'extends' / 'is'
angle   <- ('const' / 'in')? tunit (ABIN tunit)* ('?' tunit (ABIN tunit)* ':' tunit (ABIN tunit)*)* ('=' tunit (ABIN tunit)*)?
angles  <- angle (',' angle)* ','? !('=' / '>' '=')
tindex  <- type?
tuple   <- (telem (',' telem)* ','?)?
telem   <- '...'? (name '?'? ':')? type '?'?
tobject <- (tmember ((';' / ',') tmember)* (';' / ',')?)?
tmember <- tmod* (S:tmapped / key / INDEXER)? ('-' / '+')? '?'? tparams? P:params? ann? / 'new' P:params ann?
tmod    <- MODIFIER &(name / KEYWORD / STR / NUM / ANYS / reserved)
tmapped <- name 'in' type ('as' type)? / expr
targs   <- ANGLES
tparams <- ANGLES
cast    <- ('as' / SATISFIES) (type / 'const')
SATISFIES <- 'satisfies'
typed   <- (MODIFIER &('interface' / 'type' / 'enum' / 'namespace' / 'const' / 'let' / 'var' / 'function' / 'class' / MODIFIER))*
        ('interface' name tparams? ('extends' type (',' type)*)? B:tobject ';'? / 'type' name tparams? '=' type end / 'const'? 'enum' name B:enums ';'?
        / 'namespace' (name ('.' name)* / STR) (B:module / end)) / MODIFIER+ decl
enums   <- (enum (',' enum)* ','?)?
enum    <- (name / STR) ('=' one)?
"""

_SCRIPT_CLASSES = ("ID", "KEYWORD", "NUM", "STR", "RE", "PRIVATE", "MODIFIER", "TYPEOP", "OPEQ", "OP", "UN", "NEVER")
CONTINUES = ("else", "catch", "finally", ".", ",", "?", "=", "from", "&&")
_SCRIPT_LEX = re.compile(
    r"[ \t\f\v\xa0﻿]*("
    r"//[^\r\n]*|/\*[\s\S]*?\*/|(?:\r\n|\n|\r| | )\s*"
    r"|[A-Za-z_$\u0080-￿][\w$]*|#[A-Za-z_$][\w$]*"
    r"|0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:(?:0(?![\d_])|[1-9][\d_]*)\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$])"
    r"|\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"
    r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{(?:[^{}]|\{[^{}]*\})*\})*\})*`"
    r"|(?<![\w$)\]}])(?<![\w$)\]}] )/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[dgimsuvy]*(?=\s*[.,;)\]}\r\n:?&|])"
    r"|(?<=return )/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[dgimsuvy]*"
    r"|\.\.\.|=>|\?\.(?!\d)|===|!==|==|!=|<=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\*\*=|\+\+|--|\*\*|<<=|<<|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]@]"
    r"|\S)"
)
_WORDS_JS = {"with", "var", "let", "const", "function", "class", "extends", "new", "delete", "import", "export", "in", "if", "for", "return", "typeof", "void", "else", "while", "do", "switch", "case", "default", "try", "catch", "finally", "throw", "break", "continue", "instanceof", "await", "yield"}


def _script(typed: bool) -> tuple:
    grammar = Grammar(_SCRIPT + (_TYPED if typed else _PLAIN), _SCRIPT_CLASSES, "module", {"module": (("module",), "module*"), "block": (("block",), "block*"), "members": (("members",), "members*"), "cases": (("cases", "block"), "cases(?:cases|block)*")}, CONTINUES)
    cls, kinds = grammar.classes, grammar.kinds
    modifiers = {"public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor"} if typed else set()
    typeops = {"keyof", "infer", "unique", "asserts"} if typed else set()
    known = dict(kinds) | {b: b for b in "()[]{}"}
    known |= dict.fromkeys(modifiers, cls["MODIFIER"]) | dict.fromkeys(typeops, cls["TYPEOP"])
    known |= dict.fromkeys(("**=", "<<=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "&&=", "||=", "??="), cls["OPEQ"])
    known |= dict.fromkeys(("===", "!==", "==", "!=", "<=", "<<", "%", "^"), cls["OP"]) | {"~": cls["UN"]}
    if not typed:
        for w in ("type", "interface", "namespace", "is", "enum", "implements", "satisfies"):
            known.pop(w, None)
    else:
        known["module"] = kinds["namespace"]

    def classify(t: str) -> str:
        c = t[0]
        if c.isspace():
            return NEWLINE
        if c == "/" and t[1:2] == "/" or t[:2] == "/*":
            return NEWLINE if "\n" in t else ""
        if c == "#":
            return cls["PRIVATE"] if len(t) > 1 else UNKNOWN
        if c in "\"'`" and len(t) > 1:
            return cls["STR"]
        if c == "/" and len(t) > 1:
            return cls["RE"]
        if c.isdigit() or c == "." and len(t) > 1:
            return cls["NUM"]
        if c.isalpha() or c in "_$":
            return cls["ID"]
        return UNKNOWN

    # a line end between something that may end a statement and something that begins one
    ends = "".join(k for t, k in known.items() if t in (")", "]", "}", "++", "--", "break", "continue", "return", "yield", "default", "type", "of", "get", "set", "static", "from", "as", "async", "namespace", "is", "interface", "enum", "module") or t in modifiers or t in typeops)
    ends = re.escape(ends + "".join(cls[c] for c in ("ID", "KEYWORD", "NUM", "STR", "RE", "PRIVATE"))) + ("!" and re.escape(kinds["!"]) if typed else "")
    starts = "".join(k for t, k in known.items() if t in _WORDS_JS - {"else", "catch", "finally", "in", "instanceof", "extends"} or t in ("async", "of", "get", "set", "static", "from", "type", "interface", "namespace", "enum", "@", "module") or t in modifiers or t in typeops)
    starts = re.escape(starts + "".join(cls[c] for c in ("ID", "KEYWORD", "NUM", "STR", "PRIVATE")))
    semi = kinds[";"]
    members = re.compile(rf"(?<=[{ends}]){NEWLINE}+(?=[{starts}])")
    semi_start = members.sub

    def prepare(code: str, table: Kinds) -> str:
        if code.startswith("#!"):
            code = code.partition("\n")[2]
        return semi_start(semi, "".join(map(table.__getitem__, _SCRIPT_LEX.findall(code)))).replace(NEWLINE, "")

    return grammar, _SCRIPT_LEX, Kinds(known, classify), prepare


# --- Java ------------------------------------------------------------------------------------------

_JAVA = r"""
unit    <- package? imports toplevel
package <- ann* 'package' qname ';'
imports <- (';' / 'import' 'static'? qname ('.' '*')? ';')*
toplevel <- (type_decl / ';')*
qname   <- name ('.' name)*
name    <- ID / 'record' / 'sealed' / 'permits' / 'yield' / 'var' / 'when'
ann     <- '@' !'interface' qname P:annargs?
annargs <- ((name '=' annval (',' name '=' annval)*) / annval)?
annval  <- B:inits / ann / tern
mods    <- (MOD / 'static' / 'default' !':' !'->' / 'synchronized' / ann / 'sealed' &(MOD / 'class' / 'interface' / 'static') / 'non-sealed')*
type_decl <- mods ('class' name tparams? ('extends' type)? impl? perm? B:body / 'interface' name tparams? ('extends' types)? perm? B:body
        / 'enum' name impl? B:enums / 'record' name tparams? P:params impl? B:body / '@' 'interface' name B:body)
impl    <- 'implements' types
perm    <- 'permits' types
types   <- type (',' type)*
type    <- ann* (PRIM / name ANGLES? ('.' name ANGLES?)*) dims
angle   <- ann* '?' (('extends' / 'super') type)? / type ('extends' type)? ('&' type)*
angles  <- (angle (',' angle)*)?
targs   <- ANGLES
tparams <- ANGLES
dims    <- (ann* S:empty)*
empty   <- EOF
body    <- (';' / 'static'? B:block / type_decl / member)*
member  <- mods tparams? ((type / 'void') name P:params dims throws? (B:block / ('default' annval)? ';') / name P:params throws? B:block / name B:block / type vars ';')
throws  <- 'throws' types
vars    <- var (',' var)*
var     <- name dims ('=' (B:inits / expr))?
inits   <- ((B:inits / expr / ann) (',' (B:inits / expr / ann))* ','?)?
params  <- (param (',' param)* ','?)? 
param   <- (MOD / ann)* type ann* '...'? (name ('.' 'this')? / 'this') dims
enums   <- (econst (',' econst)* ','?)? (';' body)?
econst  <- ann* name P:args? B:body?
block   <- stmt*
stmt    <- (plain* 'if' P:expr)+ plain* core ('else' (plain / 'if' P:expr)* core)* / plain* core
plain   <- 'for' P:for / 'while' P:expr / name ':' !':'
for     <- (local / sexpr (',' sexpr)*)? ';' expr? ';' (sexpr (',' sexpr)*)? / (MOD / ann)* type name ':' expr
core    <- ';' / B:block / 'do' (plain* (B:block / sexpr ';' / jump)) 'while' P:expr ';' / 'switch' P:expr B:cases / 'synchronized' P:expr B:block
        / 'try' (P:res B:block catches? / B:block catches) / jump / 'assert' expr (':' expr)? ';' / local ';' / type_decl / sexpr ';'
catches <- ('catch' P:catch B:block)+ ('finally' B:block)? / 'finally' B:block
catch   <- (MOD / ann)* type ('|' type)* name
res     <- resource (';' resource)* ';'?
resource <- (MOD / ann)* type name '=' expr / expr
jump    <- 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') name? ';' / 'yield' !'=' !'.' !ANYP expr ';'
local   <- (MOD / ann)* type !'instanceof' vars
cases   <- (label '->' (B:block / expr ';' / 'throw' expr ';'))+ / (label ':' stmt*)*
label   <- 'case' clabel (',' clabel)* ('when' bin)? / 'default'
clabel  <- 'default' / type name / type P:pattern name? / unary (BIN unary)*
pattern <- (pat (',' pat)*)?
pat     <- type P:pattern name? / (MOD / ann)* type name
expr    <- tern
ASSIGN  <- '=' / OPEQ / '>' '>' '>'? '='
lambda  <- (cast)* (name / P:names / P:params) '->'
names   <- (name (',' name)*)?
sexpr   <- ('++' / '--') unary / primary post* ('++' / '--')? (ASSIGN expr / CALLED)
tern    <- bin ('?' bin ('?' bin ':' bin)* ':' bin)*
operand <- lambda+ (B:block / unary) / unary
bin     <- operand ((BIN / ASSIGN) operand / 'instanceof' (MOD / ann)* type (P:pattern name? / name)?)*
BIN     <- OP / '<' / '>' '='? / '>' '>' '>'? / '&' / '|' / '*'
unary   <- (UN / '++' / '--' / cast)* primary post* ('++' / '--')?
cast    <- P:cast &(name / NUM / STR / ANYP / UNNOT / 'this' / 'super' / 'new' / 'switch' / PRIM)
UNNOT   <- BANG
cast    <- P:cast &(name / NUM / STR / ANYP / BANG / 'this' / 'super' / 'new' / 'switch' / PRIM)
primary <- P:expr / 'this' / 'super' / NUM / STR / 'new' creator / 'switch' P:expr B:cases / PRIM dims ('.' 'class' / '::' 'new') / 'void' '.' 'class' / tref / name
tref    <- type &'::' / name targs &'::' / name dims &('.' 'class') / name S:empty+ &'::'
creator <- ann* (PRIM / name ('.' name)*) (targs)? (('.' name targs?)* P:args B:body? / S:index+ dims / S:empty+ B:inits)
post    <- '.' (targs? name / 'this' / 'super' / 'class' / 'new' creator) / P:args / S:index / '::' targs? (name / 'new')
args    <- (expr (',' expr)*)?
index   <- expr
cast    <- type ('&' type)*
"""
_JAVA = "\n".join(line for line in _JAVA.splitlines() if not line.startswith("cast    <- P:cast") and not line.startswith("UNNOT"))
_JAVA = _JAVA.replace("(cast)* (name", "castop* (name").replace("'--' / cast)* primary", "'--' / BANG / castop)* primary").replace(
    "primary <- P:expr", "castop  <- P:cast &(name / NUM / STR / ANYP / BANG / 'this' / 'super' / 'new' / 'switch' / PRIM)\nprimary <- P:expr"
)
_JAVA_CLASSES = ("ID", "NUM", "STR", "MOD", "PRIM", "OPEQ", "OP", "UN", "BANG")
_JAVA_LEX = re.compile(
    r"\s*(//[^\r\n]*|/\*[\s\S]*?\*/|non-sealed\b|[A-Za-z_$\u0080-￿][\w$]*"
    r"|0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?(?![\w$])"
    r"|\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))'"
    r"|\.\.\.|->|::|==|!=|<=|&&|\|\||\+\+|--|<<=|<<|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]@]|\S)"
)


def _java() -> tuple:
    grammar = Grammar(_JAVA, _JAVA_CLASSES, "unit", {"unit": (("package", "imports", "toplevel"), "package?imports*toplevel*"), "block": (("block",), "block*"), "body": (("body",), "body*"), "cases": (("cases", "block"), "cases(?:cases|block)*")}, ("else", "catch", "finally", ".", ","))
    cls, kinds = grammar.classes, grammar.kinds
    known = dict(kinds) | {b: b for b in "()[]{}"}
    known |= dict.fromkeys("public private protected final abstract native transient volatile strictfp".split(), cls["MOD"])
    known |= dict.fromkeys("int long double float boolean char byte short".split(), cls["PRIM"])
    known |= dict.fromkeys(("<<=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="), cls["OPEQ"])
    known |= dict.fromkeys(("==", "!=", "<=", "&&", "||", "<<", "%", "^", "/"), cls["OP"])
    known |= {"+": cls["OP"], "-": cls["OP"], "!": cls["BANG"], "~": cls["BANG"]}
    known |= dict.fromkeys("const goto".split(), UNKNOWN)
    grammar_fix = {"+": cls["UN"], "-": cls["UN"]}
    known |= grammar_fix

    def classify(t: str) -> str:
        c = t[0]
        if t[:2] in ("//", "/*") and len(t) > 1:
            return ""
        if c in "\"'" and len(t) > 1:
            return cls["STR"]
        if c.isdigit() or c == "." and len(t) > 1:
            return cls["NUM"]
        if c.isalpha() or c in "_$":
            return cls["ID"]
        return UNKNOWN

    def prepare(code: str, table: Kinds) -> str:
        return "".join(map(table.__getitem__, _JAVA_LEX.findall(code)))

    return grammar, _JAVA_LEX, Kinds(known, classify), prepare


_JAVA = _JAVA.replace("BIN     <- OP / ", "BIN     <- OP / UN / ")

# --- Go --------------------------------------------------------------------------------------------

_GO = r"""
file    <- package import* tops
package <- ';'? 'package' ID ';'
import  <- 'import' (STRSPEC / P:imports) ';'
tops    <- (top ';')* top?
STRSPEC <- (ID / '.')? STR
imports <- ((STRSPEC ';')* STRSPEC? )
top     <- 'func' P:recv? ID S:tparams? sig B:block? / decl
recv    <- ID? '*'? ID (S:types)?
decl    <- 'var' (vspec / P:vspecs) / 'const' (cspec / P:cspecs) / 'type' (tspec / P:tspecs)
vspecs  <- (vspec ';')* vspec?
cspecs  <- (cspec ';')* cspec?
tspecs  <- (tspec ';')* tspec?
vspec   <- ids (type ('=' exprs)? / '=' exprs)
cspec   <- ids (type? '=' exprs)?
tspec   <- ID S:tparams? '='? type
ids     <- ID (',' ID)*
tparams <- ids union (',' ids union)* ','?
union   <- '~'? type ('|' '~'? type)*
types   <- type (',' type)* ','?
type    <- tpre* tbase
tpre    <- '*' / S:size / 'map' S:types / 'chan' '<-'? / '<-' 'chan'
tbase   <- ID ('.' ID)? S:types? / 'func' sig / 'struct' B:fields / 'interface' B:methods / P:type
size    <- EOF / '...' / expr
sig     <- P:params (type / P:params)?
params  <- (par (',' par)* ','?)?
par     <- ID (',' ID)* '...'? type / '...'? type
fields  <- (field ';')* field?
field   <- (ids type / '*'? ID ('.' ID)? S:types?) STR?
methods <- ((ID sig / union) ';')* (ID sig / union)?
block   <- (stmt? ';')* stmt?
stmt    <- (ID ':' !'=' ';'?)* (decl / B:block / if / 'for' forhead B:block / switch / 'select' B:comm / 'return' exprs? / ('break' / 'continue') ID? / 'goto' ID / 'fallthrough'
        / ('defer' / 'go') expr / simple)
if      <- 'if' (simplen? ';')? exprn B:block ('else' 'if' (simplen? ';')? exprn B:block)* ('else' B:block)?
forhead <- (simplen? ';' exprn? ';' simplen?) / (exprsn (':=' / '='))? 'range' exprn / exprn?
switch  <- 'switch' (simplen? ';')? ((ID ':=')? exprn)? B:cases
cases   <- ((('case' (expr_t (',' expr_t)*) / 'default') ':') block)*
expr_t  <- expr / type
comm    <- (('case' simple / 'default') ':' block)*
simple  <- exprs (('=' / ':=' / OPEQ) exprs / '++' / '--' / '<-' expr)?
simplen <- exprsn (('=' / ':=' / OPEQ) exprsn / '++' / '--' / '<-' exprn)?
exprs   <- expr (',' expr)*
exprsn  <- exprn (',' exprn)*
expr    <- unary (BIN unary)*
exprn   <- unaryn (BIN unaryn)*
BIN     <- OP / '*' / '<-' / '|'
unary   <- ('*' / '<-' / UN / OPUN)* prim post*
unaryn  <- ('*' / '<-' / UN / OPUN)* primn post*
OPUN    <- '+' / '-' / '&' / '^'
prim    <- NUM / STR / 'func' sig B:block / lit / ID ('.' ID)? S:types? B:values / ID / P:expr_t / tlit
primn   <- NUM / STR / 'func' sig B:block / lit / ID / P:expr_t / tlit
lit     <- (S:size+ '*'? / 'map' S:types) tpre* tbase (B:values / P:args) / 'struct' B:fields B:values
tlit    <- ('chan' type / 'interface' B:methods / 'struct' B:fields / S:size tpre* tbase / 'map' S:types type) P:args?
post    <- '.' (ID / P:assert) / P:args / S:index / CLOSURE
assert  <- 'type' / type
args    <- (arg (',' arg)* ','?)?
arg     <- (expr / type) '...'?
index   <- expr? (':' expr? (':' expr)?)? / types
values  <- (value (',' value)* ','?)?
value   <- ((B:values / expr) ':')? (B:values / expr)
"""
_GO = _GO.replace("BIN     <- OP /", "BIN     <- OP / '+' / '-' / '&' / '^' /").replace(" / CLOSURE", "")
_GO_CLASSES = ("ID", "NUM", "STR", "OPEQ", "OP", "UN")
_GO_LEX = re.compile(
    r"[ \t\r\f\v]*(//[^\n]*|/\*[\s\S]*?\*/|\n\s*|[A-Za-z_\u0080-￿]\w*"
    r"|0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?(?!\w)"
    r"|`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:x..|u.{4}|U.{8}|[0-7]{3}|.))'"
    r"|\.\.\.|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|<<=|>>=|&\^=|<<|>>|&\^|[-+*/%&|^]=|[-+*/%&|^!~<>=:;,.(){}\[\]]|\S)"
)


def _go() -> tuple:
    grammar = Grammar(_GO, _GO_CLASSES, "file", {"file": (("package", "import", "tops"), "package(?:import)*tops*"), "block": (("block",), "block*"), "cases": (("cases", "block"), "cases(?:cases|block)*")}, ("else", ".", ","))
    cls, kinds = grammar.classes, grammar.kinds
    known = dict(kinds) | {b: b for b in "()[]{}"}
    known |= dict.fromkeys(("<<=", ">>=", "&^=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="), cls["OPEQ"])
    known |= dict.fromkeys(("==", "!=", "<=", ">=", "&&", "||", "<<", ">>", "&^", "%", "/", "<", ">"), cls["OP"]) | {"!": cls["UN"]}
    ends = re.escape(")]}" + "".join(cls[c] for c in ("ID", "NUM", "STR")) + "".join(kinds[t] for t in ("return", "break", "continue", "fallthrough", "++", "--")))
    semis = re.compile(f"(?<=[{ends}]){NEWLINE}+")
    semi = kinds[";"]

    def classify(t: str) -> str:
        c = t[0]
        if c == "\n":
            return NEWLINE
        if t[:2] in ("//", "/*") and len(t) > 1:
            return NEWLINE if "\n" in t else ""
        if c in "\"'`" and len(t) > 1:
            return cls["STR"]
        if c.isdigit() or c == "." and len(t) > 1:
            return cls["NUM"]
        if c.isalpha() or c == "_":
            return cls["ID"]
        return UNKNOWN

    def prepare(code: str, table: Kinds) -> str:
        out = "".join(map(table.__getitem__, _GO_LEX.findall(code)))
        return semis.sub(semi, out + NEWLINE).replace(NEWLINE, "")

    return grammar, _GO_LEX, Kinds(known, classify), prepare


# --- C++ -------------------------------------------------------------------------------------------

_CPP = r"""
unit    <- decl*
body    <- (access ':' / decl)*
access  <- 'public' / 'private' / 'protected'
attr    <- S:attr / 'alignas' P:args / 'explicit' P:args
attr    <- S:any
any     <- ANYS
qname   <- '::'? ID targs? ('::' (TEMPLATE? (ID / '~' ID / 'operator' OPNAME) targs? / '*'))*
TEMPLATE <- 'template'
spec    <- SPEC / 'static' / 'const' / 'typename' / 'extern' / 'explicit' P:args? / 'friend' / 'inline'
tbase   <- PRIM+ / 'auto' / 'decltype' P:args / ('enum' / 'class' / 'struct' / 'union') qname / 'typename'? qname
ptr     <- '*' / '&' / '&&' / 'const' / SPEC / '...'
type    <- spec* tbase spec* ptr* 
cexp    <- ('-' / '!' / 'sizeof' '...'?)? (NUM / STR / qname / P:args) ((ARITH / '&&' / OP) (NUM / qname / P:args))* '...'?
ARITH   <- '+' / '-' / '*'
angle   <- tmpl? ('typename' / 'class') '...'? ID? ('=' type)? / type P:params? S:index* ID? ('=' (cexp / type))? / cexp
angles  <- (angle (',' angle)*)?
targs   <- ANGLES
OPNAME  <- OPANY / '<' '='? / '>' '='? / ANYP / ANYS / '*' / '&' / '&&' / '+' / '-' / '=' / '!' / '~' / '++' / '--' / 'new' / 'delete' / type / STR ID / '->' / ',' / '<' '<' / '>' '>'
tmpl    <- 'template' ANGLES ('requires' req)?
req     <- P:expr / qname ((OP / '&&') qname)*
decl    <- ';' / attr* (tmpl attr*)* decl1 / 'template' decl1
decl1   <- 'namespace' (attr* qname)? B:unit / 'inline' 'namespace' qname B:unit / 'namespace' ID '=' qname ';' / 'extern' STR (B:unit / decl2) / 'using' ('namespace' qname / ID attr* '=' type (P:params)? / 'typename'? qname (',' qname)*) ';'
        / 'static_assert' P:args ';' / 'typedef' type declarator (',' declarator)* ';' / 'typedef'? klass / enum / 'friend' (klass / type ID? ';' ) / 'concept' ID '=' expr ';' / 'asm' P:args ';' / decl2
klass   <- SPEC* ('class' / 'struct' / 'union') attr* (qname ('final')?)? (':' base (',' base)*)? B:body (declarator (',' declarator)*)? ';' / SPEC* ('class' / 'struct' / 'union') attr* qname ';'
base    <- (access / 'virtual')* qname '...'?
enum    <- SPEC* 'enum' ('class' / 'struct')? attr* qname? (':' type)? (B:enums ID? ';' / ';')
enums   <- (ID attr* ('=' expr)? (',' ID attr* ('=' expr)?)* ','?)?
decl2   <- spec* ('~' ID / qname) P:params fsuffix (fbody / ';') / type? 'operator' OPNAME P:params fsuffix (fbody / ';')
        / type (declarator !ANYB !':' init? (',' declarator init?)* ';' / fdecl (fbody / ';') / declarator init? (',' declarator init?)* ';' / ';') / MACRO
MACRO   <- ID P:args ';'?
fdecl   <- ptr* (qname / 'operator' OPNAME / P:declp) P:params S:index* fsuffix
fsuffix <- ('const' / SPEC / 'noexcept' P:args? / '&' / '&&' / 'override' / 'final' / 'throw' P:args / attr / '->' type / 'requires' req)* 
fbody   <- (':' meminit (',' meminit)*)? B:block / '=' ('default' / 'delete' / NUM) ';' / 'try' B:block catch+
meminit <- qname (P:args / B:values) '...'?
init    <- '=' (B:values / assign) / P:args / B:values / ':' expr
declarator <- ptr* (qname / S:names / P:declp P:params?)? attr* S:index* P:params? 
declp   <- ('&' / '*' / '&&' / 'const' / ID '::' '*')* (ID S:index* P:params?)?
names   <- (ID (',' ID)*)?
params  <- (par (',' par)* (','? '...')?)? / '...'
par     <- attr* type (P:declp P:params? / ptr* ID?) S:index* ('=' (B:values / assign))?
block   <- stmt*
stmt    <- (plain* 'if' 'constexpr'? P:cond)+ attr* plain* core ('else' (plain / 'if' 'constexpr'? P:cond)* attr* core)* / plain* core
plain   <- 'for' P:for / 'while' P:cond / ID ':' !':' / 'case' tern ('...' tern)? ':' / 'default' ':' / attr
cond    <- (init_st)? (type ptr* (ID / S:names) ('=' assign / B:values) / expr)
init_st <- (type declarator init (',' declarator init)* / expr)? ';'
for     <- (type declarator init? (',' declarator init?)* / expr)? ';' (cond)? ';' expr? / (init_st)? attr* type ptr* (ID / S:names) ':' (expr / B:values)
core    <- ';' / B:block / 'do' (plain* (B:block / expr ';')) 'while' P:expr ';' / 'switch' P:cond B:block / 'try' B:block catch+ / jump / local / expr ';'
catch   <- 'catch' P:catch B:block
catch   <- '...' / par
jump    <- 'return' (B:values / expr)? ';' / 'throw' expr? ';' / ('break' / 'continue') ';' / 'goto' ID ';' / ('co_return' / 'co_yield') expr? ';'
local   <- 'using' ('namespace' qname / ID '=' type / qname) ';' / 'static_assert' P:args ';' / 'typedef' type declarator ';' / klass / enum / type declarator &('=' / ';' / ',' / ANYB) init? (',' declarator init?)* ';'
        / type ID P:args (',' ID P:args)* ';' / type ID (P:args / B:values) ';'
expr    <- assign (',' assign)*
assign  <- B:values / tern
ASSIGN  <- '=' / OPEQ / '>' '>' '='
tern    <- bin ('?' bin ('?' bin ':' bin)* ':' bin)*
bin     <- unary (BIN unary / ASSIGN (B:values / unary))*
BIN     <- OP / '<' '<'? '='? / '>' '>'? '='? / '*' / '&' / '&&' / '+' / '-' / '->*'
unary   <- ('*' / '&' / '&&' / '+' / '-' / '!' / '~' / '++' / '--' / 'sizeof' '...'? / 'co_await' / 'throw' / 'delete' (S:none)? / castop)* prim post* ('++' / '--')?
none    <- EOF
castop  <- P:cast &(ID / NUM / STR / ANYP / '~' / 'this' / 'new' / 'sizeof' / '*' / '&' / '-')
cast    <- type P:declp?
prim    <- NUM / STR+ / lambda / 'new' P:args? (type0new / P:cast) S:index* (P:args / B:values)? / CASTWORD ANGLES P:args / 'this' / 'operator' OPNAME / PRIM+ (P:args / B:values) / 'typename'? qname B:values / qname / P:expr / P:type / 'typeid' P:args / P:fold
fold    <- expr OPFOLD '...' / '...' OPFOLD expr
OPFOLD  <- OP / '&&' / '+' / '*' / ','
type0new <- spec* (PRIM+ / 'auto' / qname) '*'*
lambda  <- S:capture ANGLES? P:params? ('mutable' / 'noexcept' / SPEC / 'constexpr')* ('->' type)? B:block
capture <- (cap (',' cap)*)?
cap     <- '=' / '&' ID? ('=' assign)? '...'? / ID '...'? ('=' assign / B:values)? / '*'? 'this'
post    <- '.' TEMPLATE? ('~' ID / qname / 'operator' OPNAME) / '->' TEMPLATE? ('~' ID / qname / 'operator' OPNAME) / P:args / S:index / B:values
args    <- (arg (',' arg)*)?
arg     <- (B:values / assign / type) '...'?
index   <- (B:values / expr)?
values  <- (value (',' value)* ','?)?
value   <- ('.' ID ('=' / &ANYB) / S:index '=')? (B:values / assign) '...'?
"""
_CPP = "\n".join(x for x in _CPP.splitlines() if not x.startswith(("attr    <- S:attr", "any     <- ANYS")))
_CPP = _CPP.replace("attr    <- S:any", "attr    <- S:attrs / 'alignas' P:args\nattrs   <- S:attrin\nattrin  <- ('using' ID ':')? (ID ('::' ID)? P:args? (',' ID ('::' ID)? P:args?)*)?")
_CPP = _CPP.replace("catch+", "handler+").replace("catch   <- 'catch' P:catch", "handler <- 'catch' P:catch")
_CPP_CLASSES = ("ID", "NUM", "STR", "SPEC", "PRIM", "OPEQ", "OP", "OPANY", "CASTWORD")
_CPP_LEX = re.compile(
    r"\s*(//(?:[^\r\n\\]|\\(?:\r\n|[\s\S]))*|/\*[\s\S]*?\*/|(?<![^\n\r﻿ \t])#(?:[^\r\n\\/]|\\(?:\r\n|[\s\S])|/(?![/*])|/\*[\s\S]*?\*/)*"
    r"|(?:u8|[uUL])?R\"([^\s()\\]{0,16})\([\s\S]*?\)\2\"|(?:u8|[uUL])?\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"(?:_\w+|[a-z]+\b)?|(?:u8|[uUL])?'(?:[^'\\\r\n]|\\.)+'"
    r"|[A-Za-z_\u0080-￿]\w*|(?:0[xX][\da-fA-F']+|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:_?[A-Za-z]\w*)?"
    r"|\.\.\.|::|->\*|->|==|!=|&&|\|\||\+\+|--|[-+*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]]|\S)"
)


_DIRECTIVE = re.compile(r"#(?:[ \t]|\\\r?\n|/\*[\s\S]*?\*/)*(\w*)(.*)", re.DOTALL)
_INCLUDED = re.compile(r"[ \t]*(?:<[^>\r\n]+>|\"[^\"\r\n]+\"|[A-Za-z_]\w*[^\r\n]*)[ \t]*(?:/[/*][\s\S]*)?\s*\Z")


def _directives_hold(tokens: list[str]) -> bool:
    """Whether conditional sections open and close in order, and includes name something."""
    opened: list[bool] = []  # whether the section has its last part
    for t in tokens:
        if t[:1] != "#" or len(t) < 2:
            continue
        name, rest = _DIRECTIVE.match(t).groups()
        if name in ("if", "ifdef", "ifndef"):
            if not rest.strip():
                return False
            opened.append(False)
        elif name in ("elif", "elifdef", "elifndef", "else"):
            if not opened or opened[-1]:
                return False
            opened[-1] = name == "else"
        elif name == "endif":
            if not opened:
                return False
            opened.pop()
        elif name in ("include", "include_next", "import") and not _INCLUDED.match(rest):
            return False
        elif name in ("define", "undef") and not re.match(r"[ \t]*[A-Za-z_]", rest):
            return False
        elif name and name not in ("include", "include_next", "import", "define", "undef", "pragma", "line", "error", "warning", "embed"):
            return False
    return not opened


def _cpp() -> tuple:
    grammar = Grammar(_CPP, _CPP_CLASSES, "unit", {"unit": (("unit",), "unit*"), "block": (("block",), "block*"), "body": (("body",), "body*")}, ("else", "catch", ".", ","))
    cls, kinds = grammar.classes, grammar.kinds
    known = dict(kinds) | {b: b for b in "()[]{}"}
    known |= dict.fromkeys("constexpr consteval constinit virtual mutable volatile register thread_local".split(), cls["SPEC"])
    known |= {k: kinds[k] for k in ("constexpr", "mutable", "virtual") if k in kinds}
    known |= dict.fromkeys("int long short char bool float double void unsigned signed wchar_t char8_t char16_t char32_t".split(), cls["PRIM"])
    known |= dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="), cls["OPEQ"])
    known |= dict.fromkeys(("==", "!=", "||", "/", "%", "|", "^"), cls["OP"])
    known |= dict.fromkeys(("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"), cls["CASTWORD"])

    def classify(t: str) -> str:
        c = t[0]
        if t[:2] in ("//", "/*") or c == "#" and len(t) > 1:
            return ""
        if t[-1] in "\"'" and len(t) > 1 or c == '"' and len(t) > 1:
            return cls["STR"]
        if c.isdigit() or c == "." and len(t) > 1:
            return cls["NUM"]
        if c.isalpha() or c == "_":
            return cls["ID"]
        return UNKNOWN

    def prepare(code: str, table: Kinds) -> str:
        tokens = [a for a, _ in _CPP_LEX.findall(code)]
        return "".join([table[a] for a in tokens]) + ("" if _directives_hold(tokens) else UNKNOWN)

    return grammar, _CPP_LEX, Kinds(known, classify), prepare


# --- JSON ------------------------------------------------------------------------------------------

_JSON = r"""
text   <- value
value  <- STR / NUM / WORD / B:object / S:array
object <- (STR ':' value (',' STR ':' value)*)?
array  <- (value (',' value)*)?
"""
_JSON_LEX = re.compile(r"[ \t\r\n]*(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[\da-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b|[\[\]{},:]|\S)")


def _json() -> tuple:
    grammar = Grammar(_JSON, ("STR", "NUM", "WORD"), "text")
    cls = grammar.classes
    known = dict(grammar.kinds) | {b: b for b in "[]{}"} | dict.fromkeys(("true", "false", "null"), cls["WORD"])

    def classify(t: str) -> str:
        if t[0] == '"' and len(t) > 1:
            return cls["STR"]
        return cls["NUM"] if t[0].isdigit() or t[0] == "-" and len(t) > 1 else UNKNOWN

    def prepare(code: str, table: Kinds) -> str:
        return "".join(map(table.__getitem__, _JSON_LEX.findall(code)))

    return grammar, _JSON_LEX, Kinds(known, classify), prepare


MAKERS = {
    "javascript": lambda: _script(False),
    "typescript": lambda: _script(True),
    "java": _java,
    "go": _go,
    "cpp": _cpp,
    "json": _json,
}


# --- Python ----------------------------------------------------------------------------------------

#: Logical lines. A line becomes one sign for what it is; indented blocks are then parsed as brackets.
_LINES = r"""
start   <- simple
name    <- ID / '_' / 'match' / 'case' / 'type'
num     <- NUM / IMAG
text    <- STR+ !BYTES / BYTES+ !STR
simple  <- small (';' small)* ';'?
small   <- 'pass' / 'break' / 'continue' / 'return' exprs? / 'raise' (expr ('from' expr)?)? / ('global' / 'nonlocal') name (',' name)* / 'del' dels / 'assert' expr (',' expr)?
        / 'import' dotted ('as' name)? (',' dotted ('as' name)?)* / 'from' (DOTS* dotted / DOTS+) 'import' ('*' / P:imported / imports) / alias / assign
DOTS    <- '.' / '...'
alias   <- 'type' name S:tparams? '=' expr !'=' &DONE
DONE    <- ';' / EOF
dotted  <- name ('.' name)*
imports <- name ('as' name)? (',' name ('as' name)?)*
imported <- imports ','?
assign  <- annot ':' expr ('=' (yield / exprs))? &DONE / (targets '=')+ (yield / exprs) !'=' / single AUG (yield / exprs) / yield !'=' / exprs !'='
annot   <- name !POST / P:single !POST / prim post+ NOCALL
single  <- name !POST / P:single !POST / prim post+ NOCALL
POST    <- '.' / ANYP / ANYS
atom    <- name !POST / P:tuple !POST / S:targets0 !POST / prim post+ NOCALL
target  <- '*' !'*' target / atom
targets <- target (',' target)* ','?
targets0 <- targets?
tuple   <- target ',' targets? / atom / EOF
dels    <- del (',' del)* ','?
dels0   <- dels?
del     <- name !POST / P:dels0 !POST / S:dels0 !POST / prim post+ NOCALL
yield   <- 'yield' ('from' expr / exprs)?
exprs   <- star (',' star)* ','?
star    <- '*' bits / expr
nstars  <- nstar (',' nstar)* ','?
nstar   <- '*' bits / named
named   <- name ':=' expr / expr !':='
expr    <- 'lambda' lparams ':' expr / disj ('if' disj 'else' expr)?
disj    <- inv (('and' / 'or') inv)*
inv     <- 'not'* unary ((BIN / CMP / 'in' / 'not' 'in' / 'is' 'not'?) unary)*
bits    <- unary (BIN unary)*
BIN     <- OP / '*' / '-' / '+' / '**' / '@' / '/' / '|'
unary   <- ('-' / '+' / '~')* 'await'? prim post*
prim    <- name / num / text / CONST / '...' / P:group / S:list / B:dict
post    <- '.' name / P:args / S:slices
group   <- yield / named comp / nstar ',' nstars? / named / EOF
list    <- named comp / nstars / EOF
dict    <- expr ':' expr comp / item (',' item)* ','? / named comp / nstars / EOF
item    <- '**' bits / expr ':' expr
comp    <- ('async'? 'for' targets 'in' disj ('if' disj)*)+
args    <- named comp / arglist
cargs   <- arglist
arglist <- ((posarg (',' posarg)* (',' kwargs)? / kwargs) ','?)?
posarg  <- !KEY ('*' expr / named)
KEY     <- name '='
kwargs  <- (kwarg / '*' expr) (',' (kwarg / '*' expr))* (',' dkwargs)? / dkwargs
dkwargs <- (kwarg / '**' expr) (',' (kwarg / '**' expr))*
kwarg   <- name '=' expr
slices  <- slice (',' slice)* ','?
slice   <- expr? ':' expr? (':' expr?)? / nstar
params  <- ((ppos (',' pstars)? / pstars) ','?)?
pname   <- name (':' expr)?
pn      <- pname !'='
pd      <- pname '=' expr
ppos    <- pn (',' pn)* (',' '/' (',' pn)* (',' pd)* / (',' pd)* (',' '/' (',' pd)*)?) / pd (',' pd)* (',' '/' (',' pd)*)?
pstars  <- '*' name (':' ('*' bits / expr))? !'=' (',' (pd / pn))* (',' pkw)? / '*' (',' (pd / pn))+ (',' pkw)? / pkw
pkw     <- '**' pname !'='
lparams <- ((lpos (',' lstars)? / lstars) ','?)?
ln      <- name !'='
ld      <- name '=' expr
lpos    <- ln (',' ln)* (',' '/' (',' ln)* (',' ld)* / (',' ld)* (',' '/' (',' ld)*)?) / ld (',' ld)* (',' '/' (',' ld)*)?
lstars  <- '*' name !'=' (',' (ld / ln))* (',' lkw)? / '*' (',' (ld / ln))+ (',' lkw)? / lkw
lkw     <- '**' name !'='
tparams <- tparam (',' tparam)* ','?
tparam  <- '*' name ('=' star)? / '**' name ('=' expr)? / name (':' expr)? ('=' expr)?
h_if    <- 'if' named ':'
h_elif  <- 'elif' named ':'
h_else  <- 'else' ':'
h_while <- 'while' named ':'
h_for   <- 'async'? 'for' targets 'in' exprs ':'
h_try   <- 'try' ':'
h_exstar <- 'except' '*' expr ('as' name)? ':'
h_except <- 'except' (expr ('as' name)?)? ':'
h_finally <- 'finally' ':'
h_with  <- 'async'? 'with' (P:withs ':' / with (',' with)* ':')
withs   <- with (',' with)* ','?
with    <- expr ('as' target)?
h_def   <- 'async'? 'def' name S:tparams? P:params ('->' expr)? ':'
h_class <- 'class' name S:tparams? P:cargs? ':'
h_match <- 'match' (nstar ',' nstars? / named) ':'
h_case  <- 'case' patterns ('if' named)? ':'
patterns <- mpat ',' (mpat (',' mpat)*)? ','? / pat
mpat    <- '*' name / pat
pat     <- cpat ('|' cpat)* ('as' !'_' name !'.' !'=' !ANYP)?
cpat    <- '-'? NUM ('+' / '-') IMAG / '-'? num / text / CONST / name ('.' name)* P:pargs? / P:patterns0 / S:lpatterns / B:pdict
pargs   <- ((pkey (',' pkey)* / !PKEY pat (',' !PKEY pat)* (',' pkey (',' pkey)*)?) ','?)?
PKEY    <- name '='
pkey    <- name '=' pat
patterns0 <- patterns / EOF
lpatterns <- (mpat (',' mpat)* ','?)?
pdict   <- ((pitem (',' pitem)* (',' '**' !'_' name)? / '**' !'_' name) ','?)?
pitem   <- ('-'? NUM ('+' / '-') IMAG / '-'? num / text / CONST / name ('.' name)+) ':' pat
decor   <- '@' named
fexpr   <- yield / exprs
all     <- simple / h_if / h_elif / h_else / h_while / h_for / h_try / h_exstar / h_except / h_finally / h_with / h_def / h_class / h_match / h_case / decor
"""
_BLOCKS = r"""
suite  <- stmt+
file   <- stmt*
stmt   <- SIMPLE / EITHER / DECOR* (DEF / CLASS) B:suite / DECOR* (DEF1 / CLASS1) / if / for / try / WITH B:suite / WITH1 / MATCH B:cases
if     <- (IF B:suite / IF1) (ELIF B:suite / ELIF1)* (ELSE B:suite / ELSE1)?
for    <- (FOR B:suite / FOR1) (ELSE B:suite / ELSE1)?
try    <- (TRY B:suite / TRY1) (((EXCEPT B:suite / EXCEPT1)+ / (EXSTAR B:suite / EXSTAR1)+) (ELSE B:suite / ELSE1)? (FINALLY B:suite / FINALLY1)? / (FINALLY B:suite / FINALLY1))
cases  <- (CASE B:suite / CASE1 / EITHER)+
"""
_HEADERS = {
    "h_if": "IF", "h_elif": "ELIF", "h_else": "ELSE", "h_while": "FOR", "h_for": "FOR", "h_try": "TRY", "h_exstar": "EXSTAR", "h_except": "EXCEPT", "h_finally": "FINALLY",
    "h_with": "WITH", "h_def": "DEF", "h_class": "CLASS", "h_match": "MATCH", "h_case": "CASE",
}
_PY_CLASSES = ("ID", "NUM", "IMAG", "STR", "BYTES", "CONST", "AUG", "OP", "CMP")
#: Words that may follow a number without a blank.
_NEXT = r"(?=(?:and|else|for|if|in|is|not|or)\b)"
#: A field of a formatted text, with texts, brackets and one more field inside.
_FIELD = r"\{(?:[^{}'\"]|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|\{(?:[^{}'\"]|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|\{[^{}]*\})*\})+\}"
_PY_LEX = re.compile(
    r"(?:[ \t\f﻿]|\\(?:\r\n|\r|\n))*((?:(?:#[^\r\n]*)?(?:\r\n|\r|\n)[ \t\f]*)+|#[^\r\n]*"
    rf"|(?:[fF][rR]?|[rR][fF])(?:\"\"\"(?>[^\"\\{{}}]|\\(?:(?=[{{}}])|[\s\S])|\"(?!\"\")|{{{{|}}}}|{_FIELD})*+\"\"\"|'''(?>[^'\\{{}}]|\\(?:(?=[{{}}])|[\s\S])|'(?!'')|{{{{|}}}}|{_FIELD})*+'''|\"(?!\"\")(?>[^\"\\\r\n{{}}]|\\(?:\r\n|(?=[{{}}])|[\s\S])|{{{{|}}}}|{_FIELD})*+\"|'(?!'')(?>[^'\\\r\n{{}}]|\\(?:\r\n|(?=[{{}}])|[\s\S])|{{{{|}}}}|{_FIELD})*+')"
    r"|(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*')"
    r"|[A-Za-z_\u0080-￿]\w*"
    rf"|0[xX](?:_?[\da-fA-F])+(?:(?!\w)|{_NEXT})|0[bB](?:_?[01])+(?:(?!\w)|{_NEXT})|0[oO](?:_?[0-7])+(?:(?!\w)|{_NEXT})|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?:(?![\w.])|{_NEXT})|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?:(?!\w)|{_NEXT}))"
    r"|\d[\w.]*"
    r"|\.\.\.|->|:=|\*\*=|\*\*|//=|//|<<=|>>=|<<|>>|==|!=|<=|>=|[-+*/%&|^@]=|[-+*/%&|^@~<>=:;,.(){}\[\]]|\S)"
)
_PY_NUMBER = re.compile(r"0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?0)*|[1-9](?:_?\d)*|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)[jJ]?|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)[jJ]?|\d(?:_?\d)*[jJ]")
_INDENT = 0x4000


#: Escapes of texts and of bytes that are none.
_ESCAPE = re.compile(r"\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U(?:000[\da-fA-F]|0010)[\da-fA-F]{4}|N\{([^{}]+)\}|([xuUN])|[\s\S])")
_BYTE_ESCAPE = re.compile(r"\\(?:x[\da-fA-F]{2}|(x)|[\s\S])")
_PREFIX = re.compile(r"[A-Za-z]*")
_FIELD_END = re.compile(r"'{3}[\s\S]*?'{3}|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|[!=<>]=|[()\[\]{}!:=]")


def _escapes_hold(text: str) -> bool:
    for m in _ESCAPE.finditer(text):
        if m[2]:
            return False
        if m[1]:
            try:
                unicodedata.lookup(m[1])
            except KeyError:
                return False
    return True


class PythonGrammar:
    """The two stages as one: lines, then blocks."""

    def __init__(self) -> None:
        marks = re.compile(f"[{chr(_INDENT)}-{chr(_INDENT + 0xFFF)}]")
        self.lines = Grammar(_LINES, _PY_CLASSES, "all", {}, (), marks)
        names = ["SIMPLE", "DECOR", *dict.fromkeys(_HEADERS.values())]
        names += [n + "1" for n in names[2:]] + ["EITHER"]
        self.blocks = Grammar(_BLOCKS, tuple(names), "file")
        self.split = re.compile(f"([{chr(_INDENT)}-{chr(_INDENT + 0xFFF)}])").split
        self.known: dict[str, str] = {}
        #: Columns of an indentation, with tabs of eight and of one.
        self.depths: list[tuple[int, int]] = [(0, 0)]
        self.depth_of: dict[tuple[int, int], str] = {(0, 0): chr(_INDENT)}
        cls, kinds = self.lines.classes, self.lines.kinds
        known = dict(kinds) | {b: b for b in "()[]{}"} | dict.fromkeys(("True", "False", "None"), cls["CONST"])
        known |= dict.fromkeys(("**=", "//=", "<<=", ">>=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@="), cls["AUG"])
        known |= dict.fromkeys(("//", "<<", ">>", "%", "&", "^"), cls["OP"]) | dict.fromkeys(("==", "!=", "<=", ">=", "<", ">"), cls["CMP"])
        self.bar = kinds["|"]

        def classify(t: str) -> str:
            c = t[0]
            if c in "\r\n" or c == "#" and t[-1] != c and ("\n" in t or "\r" in t):
                return self.indent(re.split(r"[\r\n]", t)[-1])
            if c == "#":
                return ""
            if t[-1] in "\"'" and len(t) > 1:
                return self.text(t)
            if c.isdigit() or c == "." and len(t) > 1 and t != "...":
                if not _PY_NUMBER.fullmatch(t):
                    return UNKNOWN
                return cls["IMAG" if t[-1] in "jJ" else "NUM"]
            return cls["ID"] if t.isidentifier() else UNKNOWN

        self.table = Kinds(known, classify)
        self.kind = {name: k for name, k in self.blocks.classes.items()}
        self.rules = [("simple", "SIMPLE"), *_HEADERS.items(), ("decor", "DECOR")]
        rules = self.lines
        body = rules._rule
        heads = "|".join(f"(?P<x{i}>(?>{body(r)}))" for i, (r, _) in enumerate(self.rules) if r.startswith("h_"))
        plain, tail, field = f"(?:(?P<simple>{body('simple')})|(?P<decor>{body('decor')}))", body("simple"), body("fexpr")
        define = "(?(DEFINE)" + "".join(f"(?P<{n}>{rules._made[n]})" for n in sorted(rules._called)) + ")"
        self.head = regex.compile(f"{define}(?:{heads})(?:(?P<tail>{tail})\\Z|\\Z)")
        self.plain = regex.compile(f"{define}{plain}\\Z")
        self.field = regex.compile(f"{define}{field}\\Z")

    def indent(self, blanks: str) -> str:
        """The sign of an indentation; a form feed begins the line anew."""
        blanks = blanks.rpartition("\f")[2]
        at = (len(blanks.expandtabs(8)), len(blanks))
        if at not in self.depth_of:
            if len(self.depths) > 0xF00:
                raise ValueError("too many indentations in one worker")
            self.depth_of[at] = chr(_INDENT + len(self.depths))
            self.depths.append(at)
        return self.depth_of[at]

    def text(self, t: str) -> str:
        """The kind of a literal, if its escapes and fields hold."""
        prefix = _PREFIX.match(t)[0].lower()
        size = 3 if t[len(prefix) : len(prefix) + 3] in ('\"\"\"', "\'\'\'") and len(t) >= len(prefix) + 6 else 1
        inner = t[len(prefix) + size : -size]
        cls = self.lines.classes
        if "b" in prefix:
            if not inner.isascii() or "r" not in prefix and any(m[1] for m in _BYTE_ESCAPE.finditer(inner)):
                return UNKNOWN
            return cls["BYTES"]
        if "f" in prefix:
            return cls["STR"] if self.formatted(inner, "r" in prefix, t[-size:]) else UNKNOWN
        return cls["STR"] if "r" in prefix or "\\" not in inner or _escapes_hold(inner) else UNKNOWN

    def formatted(self, inner: str, raw: bool, quote: str, depth: int = 0) -> bool:
        """Whether the fields of a formatted text hold expressions."""
        at, size = 0, len(inner)
        plain: list[str] = []
        while at < size:
            c = inner[at]
            if c == "\\" and not raw and inner[at + 1 : at + 3] == "N{":
                end = inner.find("}", at)
                if end < 0:
                    return False
                plain.append(inner[at : end + 1])
                at = end + 1
            elif c in "{}" and inner[at + 1 : at + 2] == c and not (depth and c == "}"):
                at += 2
            elif c == "}":
                return False
            elif c == "{":
                at = self.one_field(inner, at + 1, raw, quote, depth)
                if at < 0:
                    return False
            elif c == "\\":
                step = 1 if inner[at + 1 : at + 2] in ("{", "}") else 2
                plain.append(inner[at : at + 2] if step == 2 else "\\\\")
                at += step
            else:
                plain.append(c)
                at += 1
        said = "".join(plain)
        return quote not in said and (len(quote) == 3 or "\n" not in said) and (raw or _escapes_hold(said)) if depth else raw or _escapes_hold(said)

    def one_field(self, inner: str, start: int, raw: bool, quote: str, depth: int) -> int:
        """Where the field that begins at ``start`` ends, or -1."""
        opened, end = [], -1
        for m in _FIELD_END.finditer(inner, start):
            c = m[0]
            if c in ("(", "[", "{"):
                opened.append(c)
            elif c in (")", "]", "}"):
                if c == "}" and not opened:
                    end = m.start()
                    break
                if not opened or opened.pop() + c not in ("()", "[]", "{}"):
                    return -1
            elif not opened and c in ("!", ":", "="):
                end = m.start()
                break
        if end < 0 or not self.expression(inner[start:end]):
            return -1
        rest = inner[end:]
        at = end
        if rest[0] == "=":
            at += 1
            while inner[at : at + 1] in (" ", "\t"):
                at += 1
        if inner[at : at + 1] == "!":
            m = re.compile(r"![rsa]\s*(?=[:}])").match(inner, at)
            if m is None:
                return -1
            at = m.end()
        if inner[at : at + 1] == "}":
            return at + 1
        if inner[at : at + 1] != ":" or depth > 1:
            return -1
        # the format runs to the brace that closes the field, with fields of its own
        level, spec = 0, at + 1
        for i in range(spec, len(inner)):
            if inner[i] == "{":
                level += 1
            elif inner[i] == "}":
                if not level:
                    return i + 1 if self.formatted(inner[spec:i], raw, quote, depth + 1) else -1
                level -= 1
        return -1

    def expression(self, code: str) -> bool:
        tokens = _PY_LEX.findall(code)
        if "#" in code and "\n" not in code and any(t[0] == "#" for t in tokens):
            return False
        kinds = "".join(map(self.table.__getitem__, tokens))
        content = self.lines.typed(self.lines.reduce("(" + kinds + ")"))
        if len(content) != 1 or not kinds:
            return False
        # brackets let the expression go over lines; what is inside is matched by itself
        marks = self.lines.dropped
        return self.field.match(marks.sub("", self.lines.reduce(kinds))) is not None

    def line(self, content: str) -> str:
        found = self.known.get(content)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            m = self.plain.match(content)
            if m:
                found = self.kind["SIMPLE" if m["simple"] is not None else "DECOR"]
                # ``case[a]: b = c`` is a case in one place and a typed assignment in another
                if content[0] == self.lines.kinds["case"] and self.head.match(content):
                    found = self.kind["EITHER"]
            elif m := self.head.match(content):
                rule = next(kind for i, (_, kind) in enumerate(self.rules) if kind not in ("SIMPLE", "DECOR") and m[f"x{i}"] is not None)
                found = self.kind[rule + ("1" if m["tail"] is not None else "")]
            else:
                found = UNKNOWN
            self.known[content] = found
        return found

    def parses(self, code: str) -> bool:
        table = self.table
        if "\0" in code:
            return False
        first = self.indent(code[: len(code) - len(code.lstrip(" \t\f"))])
        kinds = self.lines.reduce(first + "".join(map(table.__getitem__, _PY_LEX.findall(code))))
        pieces = self.split(kinds)
        if pieces[0]:
            return False
        out, stack, line = [], [(0, 0)], self.line
        for i in range(1, len(pieces), 2):
            content = pieces[i + 1]
            if not content:
                continue
            depth = self.depths[ord(pieces[i]) - _INDENT]
            if depth[0] > stack[-1][0]:
                if depth[1] <= stack[-1][1]:
                    return False  # tabs and blanks that agree only at one width
                stack.append(depth)
                out.append("{")
            else:
                while depth[0] < stack[-1][0]:
                    stack.pop()
                    out.append("}")
                if depth != stack[-1]:
                    return False
            found = line(content)
            if found == UNKNOWN:
                return False
            out.append(found)
        out.append("}" * (len(stack) - 1))
        return self.blocks.parses("".join(out))


# --- CSS and HTML: readers that never fail, so only what is left open, left over or foreign ---------

#: Lines that a merge leaves behind.
MERGE = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: .*)?$|^={7}\r?$", re.MULTILINE)

_CSS = r"""
sheet    <- (at / rule / STR* ';')*
at       <- AT prelude (';' / B:decls / EOF)
prelude  <- (ID / NUM / STR / HASH / AT / P:any / S:any / ',' / ':' / '.' / '>' / '<' / '=' / '/' / '*' / '+' / '~' / '|' / '&' / '-' / '!')*
rule     <- selector+ B:decls
selector <- ID / HASH / '.' ID / '*' / S:any / ':' ':'? ID P:any? / P:any / '>' / '+' / '~' / ',' / '|' / NUM / '&' / '%'
decls    <- (';' / at / decl (';' / EOF) / rule)*
decl     <- '*'? (ID / '-' ID) ':' (value &(';' / EOF) / anyval)
anyval   <- (ANYB / ANYP / ANYS / ID / NUM / STR / HASH / AT / ',' / ':' / '.' / '!' / '/' / '*' / '+' / '-' / '=' / '>' / '<' / '%' / '|' / '~' / '&' / '#' / '?' / '^' / '$')*
value    <- (ID / NUM / STR / HASH / P:any / S:any / B:decls / ',' / '/' / '+' / '-' / '*' / '.' / '=' / ':' / '!' / '%' / AT / '>' / '<' / '|' / '~' / '&' / '#')*
any      <- (ID / NUM / STR / HASH / AT / P:any / S:any / B:decls / ',' / '/' / '+' / '-' / '*' / '.' / '=' / ':' / '!' / '%' / '>' / '<' / '|' / '~' / '&' / ';' / '^' / '$' / '#' / '?')*
"""
_CSS_LEX = re.compile(
    r"\s*(/\*[\s\S]*?\*/|<!--|-->|[uU][rR][lL]\(\s*(?:[^\"'()\\\s]|\\.)+\s*\)|\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'"
    r"|@-?[A-Za-z_][\w-]*|#[\w-]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:%|[A-Za-z]+)?|(?:--|-?[A-Za-z_\u0080-￿\\])(?:[\w\u0080-￿-]|\\.)*|\S)"
)


def _css() -> tuple:
    grammar = Grammar(_CSS, ("ID", "NUM", "STR", "HASH", "AT"), "sheet", {"sheet": (("sheet",), "sheet*")})
    cls = grammar.classes
    known = dict(grammar.kinds) | {b: b for b in "()[]{}"}

    def classify(t: str) -> str:
        c = t[0]
        if t[:2] == "/*" and len(t) > 3 or t in ("<!--", "-->"):
            return ""
        if c in "\"'" and len(t) > 1 or t[:4].lower() == "url(":
            return cls["STR"]
        if c == "@":
            return cls["AT"] if len(t) > 1 else UNKNOWN
        if c == "#":
            return cls["HASH"]
        if c.isdigit() or len(t) > 1 and c in "+-." and t[1] in ".0123456789":
            return cls["NUM"]
        return cls["ID"] if c.isalpha() or c in "_-\\" or c > "\x7f" else UNKNOWN

    def prepare(code: str, table: Kinds) -> str:
        marked = MERGE.sub("\x01", re.sub(r"/\*[\s\S]*?\*/", " ", code)) if MERGE.search(code) else code
        return "".join(map(table.__getitem__, _CSS_LEX.findall(marked)))

    return grammar, _CSS_LEX, Kinds(known, classify), prepare


MAKERS["css"] = _css

_MARKUP = re.compile(
    r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<[!?][^<>]*>"
    r"|<(script|style|textarea|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>[\s\S]*?</\1\s*>"
    r"|<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[A-Za-z/!?])",
    re.IGNORECASE,
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAY_STAY_OPEN = set("li p dt dd tr td th thead tbody tfoot option optgroup colgroup rt rp html head body".split())


class HtmlGrammar:
    """Elements as brackets whose names must agree, innermost first."""

    def place(self, code: str) -> tuple[int, str] | None:
        """Where and why the text is no HTML, or None."""
        signs, at, names, end = [], [], {}, 0
        text = []
        for m in _MARKUP.finditer(code):
            text.append(code[end : m.start()])
            end = m.end()
            if m[3]:
                name = m[3].lower()
                if name in VOID or m[4].endswith("/") and not m[2]:
                    if m[2] and name != "br":
                        return m.start(), "closed without being opened"
                    continue
                sign = names.setdefault(name, chr(0x100 + len(names)))
                signs.append(("c" if m[2] else "o") + sign)
                at.append((m.start(), bool(m[2]), name))
            elif m[0] == "<":
                return m.start(), "left open"
        text.append(code[end:])
        if not end:
            return 0, "other language"
        rest = "".join(text)
        if (m := MERGE.search(rest)) is not None:
            return max(0, code.find(m[0])), "merge conflict"
        optional = "".join(s for n, s in names.items() if n in MAY_STAY_OPEN)
        kinds, n = "".join(signs), 1
        pair = re.compile("o(.)" + (f"(?:o[{optional}])*" if optional else "") + r"c\1")
        while n:
            kinds, n = pair.subn("", kinds)
        if optional:
            kinds = re.sub(f"o[{optional}]", "", kinds)
        if not kinds:
            return None
        left, closes = {v: k for k, v in names.items()}[kinds[1]], kinds[0] == "c"
        return next((p for p, c, name in at if name == left and c == closes), 0), "closed without being opened" if closes else "left open"

    def parses(self, code: str) -> bool:
        return self.place(code) is None

"""Lexers and parsing-expression grammars of the source languages.

A lexer turns a text into token kinds (keywords and punctuation stand for
themselves), start offsets and, for JavaScript, line-end flags; it returns the
offset of the first text that is no token instead. The grammars cover the
published syntax of each language as of 2025; only syntax is judged, with the
early errors that a wrong cut produces most (a `return` outside a function).
Python is parsed by the interpreter's own generated packrat PEG parser.
"""

from __future__ import annotations

import re
import sys
import warnings

from .peg import Grammar


class LexError(Exception):
    def __init__(self, at: int):
        self.at = at


# -- Rust ---------------------------------------------------------------------

_RUST = re.compile(
    r"""(?P<ws>[\s‎‏]+|//[^\n]*)|(?P<bc>/\*)
    |(?P<raw>(?:b|c)?r(?P<h>\#*)")|(?P<str>(?:b|c)?"(?:\\(?:.|\n|\r\n)|[^"\\])*")
    |(?P<chr>b?'(?:\\(?:u\{[0-9A-Fa-f_]{1,8}\}|x[0-9A-Fa-f]{2}|.)|[^'\\\n\r\t])')
    |(?P<life>'(?:r\#)?[A-Za-z_]\w*(?!'))
    |(?P<num>0x[0-9A-Fa-f_]+\w*|0o[0-7_]+\w*|0b[01_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)
    |(?P<id>(?:r\#)?[^\W\d]\w*)
    |(?P<op><<=|\.\.\.|\.\.=|::|->|=>|==|!=|<=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|\.\.|[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]])""",
    re.X,
)
_RUST_KEYWORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try".split()
)
_BLOCK = re.compile(r"/\*|\*/")


def lex_rust(text: str) -> tuple[list[str], list[int], None]:
    kinds: list[str] = []
    starts: list[int] = []
    at, n, match = 0, len(text), _RUST.match
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = match(text, at)
        if m is None:
            raise LexError(at)
        kind = m.lastgroup
        end = m.end()
        if kind == "ws":
            at = end
            continue
        if kind == "bc":
            depth = 1
            while depth:
                b = _BLOCK.search(text, end)
                if b is None:
                    raise LexError(n)
                depth += 1 if b.group() == "/*" else -1
                end = b.end()
            at = end
            continue
        if kind == "op":
            k = m.group()
        elif kind == "id":
            k = m.group()
            k = k if k in _RUST_KEYWORDS else "_" if k == "_" else "ID"
        elif kind == "num":
            k = "NUM"
        elif kind == "life":
            k = "LIFE"
        elif kind == "h" or kind == "raw":
            close = text.find('"' + m.group("h"), end)
            if close < 0:
                raise LexError(n)
            end = close + 1 + len(m.group("h"))
            k = "STR"
        else:
            k = "STR" if kind == "str" else "CHR"
        kinds.append(k)
        starts.append(at)
        at = end
    kinds.append("EOF")
    starts.append(n)
    return kinds, starts, None


RUST_TEXT = r"""
file = inner_attr* item* EOF
$ident : ID union auto
$lit : NUM STR CHR true false
$segment : ID self Self super crate
$binop : + - * / % ^ & | && || == != < <= = += -= *= /= %= ^= &= |= <<= <<
$unary : - * !
$tt : ID NUM STR CHR LIFE _ as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn abstract become box do final macro override priv typeof unsized virtual yield try <<= ... ..= :: -> => == != <= && || += -= *= /= %= ^= &= |= << .. - + * / % ^ ! & | = < > @ . , ; : # $ ? ~
inner_attr = '#' '!' bracket_tree
attr = '#' bracket_tree
bracket_tree = '[' tree* ']'
delim_tree = '(' tree* ')' / '[' tree* ']' / '{' tree* '}'
tree = $tt / delim_tree
vis = 'pub' ( '(' ( 'crate' / 'self' / 'super' / 'in' path_simple ) ')' )?
path_simple = '::'? $segment ( '::' $segment )*
item = attr* vis? item_kind
item_kind = use_item / fn_item / struct_item / enum_item / impl_item / trait_item / mod_item / const_item / static_item / type_item / extern_item / macro_item
use_item = 'use' use_tree ';'
use_tree = '::'? ( '*' / '{' ( use_tree ( ',' use_tree )* ','? )? '}' / $segment ( '::' $segment )* ( '::' ( '*' / '{' ( use_tree ( ',' use_tree )* ','? )? '}' ) / 'as' ( ID / '_' ) )? )
fn_quals = 'const'? 'async'? 'unsafe'? ( 'extern' STR? )?
fn_item = fn_quals 'fn' ID generics? '(' fn_params? ')' ret? where? ( block / ';' )
fn_params = attr* ( self_param / fn_param ) ( ',' attr* fn_param )* ','?
self_param = ( '&' LIFE? )? 'mut'? 'self' ( ':' type )?
fn_param = '...' / pattern_top ':' ( '...' / type )
ret = '->' type
generics = '<' ( generic ( ',' generic )* ','? )? '>'
generic = attr* ( LIFE ( ':' life_bounds? )? / 'const' ID ':' type ( '=' ( block / '-'? $lit / ID ) )? / ID ( ':' bounds? )? ( '=' type )? )
life_bounds = LIFE ( '+' LIFE )* '+'?
bounds = bound ( '+' bound )* '+'?
bound = LIFE / '(' bound_inner ')' / bound_inner / 'use' '<' ( ( LIFE / ID / 'Self' ) ( ',' ( LIFE / ID / 'Self' ) )* ','? )? '>'
bound_inner = '?'? ( '~' 'const' )? for_lives? type_path
for_lives = 'for' generics
where = 'where' ( where_pred ( ',' where_pred )* ','? )?
where_pred = LIFE ':' life_bounds? / for_lives? type ':' bounds?
struct_item = 'struct' ID generics? where? ( '{' fields? '}' / '(' tuple_fields? ')' where? ';' / ';' )
fields = field ( ',' field )* ','?
field = attr* vis? ( ID ) ':' type ( '=' expr )?
tuple_fields = attr* vis? type ( ',' attr* vis? type )* ','?
enum_item = 'enum' ID generics? where? '{' ( variant ( ',' variant )* ','? )? '}'
variant = attr* vis? ID ( '{' fields? '}' / '(' tuple_fields? ')' )? ( '=' expr )?
impl_item = 'unsafe'? 'impl' ( generics !generics )? 'const'? ( '!'? type_path_or 'for' )? type where? '{' inner_attr* assoc* '}'
type_path_or = type
assoc = attr* vis? 'default_'? ( fn_item / const_item / type_item / macro_item )
trait_item = 'unsafe'? ( 'auto_' )? 'trait' ID generics? ( ':' bounds? )? where? ( '{' inner_attr* assoc* '}' / '=' bounds where? ';' )
mod_item = 'unsafe'? 'mod' ID ( ';' / '{' inner_attr* item* '}' )
const_item = 'const' ( ID / '_' ) generics? ( ':' type )? ( '=' expr )? where? ';'
static_item = 'unsafe'? 'static' 'mut'? ID ':' type ( '=' expr )? ';'
type_item = 'type' ID generics? ( ':' bounds? )? where? ( '=' type )? where? ';'
extern_item = 'extern' 'crate' ( ID / 'self' ) ( 'as' ( ID / '_' ) )? ';' / 'unsafe'? 'extern' STR? '{' inner_attr* ( attr* vis? ( fn_item / static_item / type_item / macro_item ) )* '}'
macro_item = path_simple '!' ID? ( '{' tree* '}' / '(' tree* ')' ';' / '[' tree* ']' ';' )
@memo type = type_no_plus ( '+' bound )*
type_no_plus = '(' ( type ( ',' type )* ','? )? ')' / '!' / '&' LIFE? 'mut'? type_no_plus / '&&' LIFE? 'mut'? type_no_plus / '*' ( 'mut' / 'const' ) type_no_plus / '[' type ( ';' expr )? ']' / '_' / ( 'dyn' / 'impl' ) bounds / for_lives? fn_type / for_lives? type_path ( '!' delim_tree )? / qpath_type
fn_type = 'unsafe'? ( 'extern' STR? )? 'fn' '(' ( fn_type_param ( ',' fn_type_param )* ','? )? ')' ( '->' type_no_plus )?
fn_type_param = attr* ( '...' / ( ( ID / '_' ) ':' )? type )
qpath_type = '<' type ( 'as' type_path )? '>' ( '::' type_seg )+
type_path = '::'? type_seg ( '::' type_seg )*
type_seg = $segment ( '::'? ( generic_args / '(' ( type ( ',' type )* ','? )? ')' ( '->' type_no_plus )? ) )?
generic_args = '<' ( generic_arg ( ',' generic_arg )* ','? )? '>'
generic_arg = LIFE / ID generic_args? ( '=' !'=' type / ':' bounds ) / type / block / '-'? $lit
block = '{' inner_attr* stmt* expr_no_attr? '}'
stmt = ';' / attr* let_stmt / item / attr* ( block_like !( '.' / '?' ) ';'? / macro_stmt / expr ( ';' / &'}' ) )
macro_stmt = path_simple '!' '{' tree* '}' !( '.' / '?' ) ';'?
let_stmt = 'let' pattern_top ( ':' type )? ( '=' expr ( 'else' block )? )? ';'
expr_no_attr = attr* expr
block_like = if_expr / match_expr / while_expr / for_expr / loop_expr / labeled / block / 'unsafe' block / 'const' block / 'async' 'move'? block
labeled = LIFE ':' ( loop_expr / while_expr / for_expr / block )
loop_expr = 'loop' block
while_expr = 'while' cond block
for_expr = 'for' pattern_top 'in' exprn block
if_expr = 'if' cond block ( 'else' ( if_expr / block ) )?
cond = condn ( ( '&&' / '||' ) condn )*
condn = 'let' pattern_top '=' exprc / exprn
match_expr = 'match' exprn '{' inner_attr* ( arm )* '}'
arm = attr* '|'? pattern_top ( 'if' cond_expr )? '=>' ( block_like ( ',' / &( '}' / '|' / arm_start ) ) / expr ( ',' / &'}' ) )
arm_start = attr* pattern_top ( 'if' cond_expr )? '=>'
cond_expr = ( 'let' pattern_top '=' exprc / expr ) ( '&&' ( 'let' pattern_top '=' exprc / expr ) )*
pattern_top = '|'? pattern ( '|' pattern )*
@memo pattern = pat_range_start / pat_prim
pat_range_start = ( '..=' / '..' ) pat_bound
pat_prim = '..' / '&' 'mut'? pattern / '&&' 'mut'? pattern / '(' ( pattern_top ( ',' pattern_top )* ','? )? ')' / '[' ( pattern_top ( ',' pattern_top )* ','? )? ']' / '_' / 'ref' 'mut'? ID ( '@' pattern )? / 'mut' ( ID / 'self' ) ( '@' pattern )? / pat_bound ( ( '..=' / '...' / '..' ) pat_bound? )? ( !( '..' ) ) / 'box' pattern / 'const' block
pat_bound = '-'? NUM / STR / CHR / 'true' / 'false' / ID '@' pattern_top / expr_path ( '!' delim_tree / '{' pat_fields? '}' / '(' ( pattern_top ( ',' pattern_top )* ','? )? ')' )?
pat_fields = pat_field ( ',' pat_field )* ','?
pat_field = attr* ( '..' / ( ID / NUM ) ':' pattern_top / 'box'? 'ref'? 'mut'? ID )
expr_path = '<' type ( 'as' type_path )? '>' ( '::' expr_seg )+ / '::'? expr_seg ( '::' expr_seg )*
expr_seg = $segment ( '::' generic_args )?
args = '(' ( expr_no_attr ( ',' expr_no_attr )* ','? )? ')'
@memo closure = ( 'for' generics )? 'static'? 'async'? 'move'? ( '||' / '|' ( closure_param ( ',' closure_param )* ','? )? '|' ) ( '->' type_no_plus block / expr )
@memo closuren = ( 'for' generics )? 'static'? 'async'? 'move'? ( '||' / '|' ( closure_param ( ',' closure_param )* ','? )? '|' ) ( '->' type_no_plus block / exprn )
closure_param = attr* pattern ( ':' type )?
shift_or_gt = '>' '>'? '='?
field_access = '.' ( 'await' / NUM / $segment ( '::' generic_args )? args? )
struct_body = '{' ( struct_field ( ',' struct_field )* ','? )? '}'
struct_field = attr* ( '..' expr? / ( ID / NUM ) ':' expr / ID )
"""

_RUST_EXPR = r"""
expr~ = range~ ( ( $binop / shift_or_gt ) range~ )*
range~ = ( '..=' / '..' ) operand~? / operand~ ( ( '..=' / '..' ) ( !'{' operand~ / NOBRACE )? )?
operand~ = closure! / jump~ / prefix~ ( 'as' type_no_plus )*
jump~ = 'return' expr~? / 'break' LIFE? ( NOBRACE expr~ )? / 'continue' LIFE? / 'yield' expr~? / 'become' expr~
prefix~ = ( $unary / '&&' ( 'raw_' )? 'mut'? / '&' 'mut'? )* ( postfix~ / jump~ / closure! )
postfix~ = primary~ ( field_access / '?' / args / '[' expr ']' )*
primary~ = $lit / '(' inner_attr* ( expr_no_attr ( ',' expr_no_attr )* ','? )? ')' / '[' inner_attr* ( expr_no_attr ( ';' expr / ( ',' expr_no_attr )* ','? ) )? ']' / block_like / '_' / path_expr~
path_expr~ = expr_path ( '!' delim_tree STRUCT )?
"""


def _rust_text() -> str:
    out = RUST_TEXT
    for suffix in ("", "n", "c"):
        t = _RUST_EXPR.replace("closure!", "closure" + ("n" if suffix else ""))
        t = t.replace("( !'{' operand~ / NOBRACE )?", "( !'{' operand~ )?" if suffix else "operand~?").replace("( NOBRACE expr~ )?", "( !'{' expr~ )?" if suffix else "expr~?")
        t = t.replace("( '!' delim_tree STRUCT )?", "( '!' delim_tree )?" if suffix else "( '!' delim_tree / struct_body )?")
        if suffix == "c":  # after `let p =` in a condition: a lazy boolean operator ends the scrutinee
            t = t.replace("$binop", "$binop_scrutinee")
        out += t.replace("~", suffix)
    return out + "\n$binop_scrutinee : + - * / % ^ & | == != < <= <<\n"


# -- Go --------------------------------------------------------------------------

_GO = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*(?s:.*?)\*/)
    |(?P<str>`[^`]*`|"(?:\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|[^"\\\n])*")
    |(?P<chr>'(?:\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|[^'\\\n])')
    |(?P<num>(?:0[xX][0-9A-Fa-f_]*(?:\.[0-9A-Fa-f_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)(?![^\W_])
    |(?P<id>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.X,
)
_GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_ENDS = frozenset(["ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def lex_go(text: str) -> tuple[list[str], list[int], None]:
    kinds: list[str] = []
    starts: list[int] = []
    at, n, match = 0, len(text), _GO.match
    last = ""
    while at < n:
        m = match(text, at)
        if m is None:
            raise LexError(n if text.startswith(("/*", "`"), at) else at)
        kind, end = m.lastgroup, m.end()
        if kind == "ws" or kind == "lc":
            at = end
            continue
        if kind == "nl" or kind == "bc":
            if last in _GO_ENDS and (kind == "nl" or "\n" in m.group()):
                kinds.append(";")
                starts.append(at)
                last = ";"
            at = end
            continue
        if kind == "op":
            last = m.group()
        elif kind == "id":
            last = m.group()
            last = last if last in _GO_KEYWORDS else "ID"
        else:
            last = "NUM" if kind == "num" else "STR" if kind == "str" else "CHR"
        kinds.append(last)
        starts.append(at)
        at = end
    if last in _GO_ENDS:
        kinds.append(";")
        starts.append(n)
    kinds.append("EOF")
    starts.append(n)
    return kinds, starts, None


GO_TEXT = r"""
file = 'package' ID ';' ( import_decl ';' )* ( top_decl ';' )* EOF
$binop : || && == != < <= > >= + - | ^ * / % << >> & &^
$unary : + - ! ^ * & <- ~
$assign : = := += -= *= /= %= &= |= ^= <<= >>= &^=
$lit : NUM STR CHR
semi = ';' / &( ')' / '}' )
import_decl = 'import' ( import_spec / '(' ( import_spec semi )* ')' )
import_spec = ( '.' / ID )? STR
top_decl = func_decl / decl
decl = 'const' ( const_spec / '(' ( const_spec semi )* ')' ) / 'var' ( var_spec / '(' ( var_spec semi )* ')' ) / 'type' ( type_spec / '(' ( type_spec semi )* ')' )
idents = ID ( ',' ID )*
const_spec = idents ( type? '=' exprs )?
var_spec = idents ( '=' exprs / type ( '=' exprs )? )
type_spec = ID ( type_params &( '=' / type ) )? '='? type
type_params = '[' type_param ( ',' type_param )* ','? ']'
type_param = idents constraint
constraint = '~'? type ( '|' '~'? type )*
func_decl = 'func' receiver? ID type_params? signature block?
receiver = '(' ( ID '*'? recv_type / '*'? recv_type ) ','? ')' / '(' ID? '(' '*'? recv_type ')' ')'
recv_type = qual ( '[' idents ','? ']' )?
signature = params result?
result = params / type
params = '(' ( param ( ',' param )* ','? )? ')'
param = ID '...' type / ID type !'.' / '...' type / type
qual = ID ( '.' ID )?
@memo type = '*' type / '(' type ')' / '[' ']' type / '[' ( '...' / expr ) ']' type / 'map' '[' type ']' type / chan_type / 'func' signature / struct_type / interface_type / qual type_args?
type_args = '[' type ( ',' type )* ','? ']'
chan_type = 'chan' '<-'? type / '<-' 'chan' type
struct_type = 'struct' '{' ( field semi )* '}'
field = ( '*'? qual type_args? &( STR / ';' / '}' ) / idents type ) STR?
interface_type = 'interface' '{' ( elem semi )* '}'
elem = ID params result? / constraint
block = '{' stmts '}'
stmts = ( stmt ( ';' / &( '}' / 'case' / 'default' / EOF ) ) / ';' )*
stmt = decl / block / if_stmt / for_stmt / switch_stmt / select_stmt / 'return' exprs? / 'go' expr / 'defer' expr / 'goto' ID / 'break' ID? / 'continue' ID? / 'fallthrough' / ID ':' ( &( '}' ) / stmt ) / simple
simple = exprs ( $assign exprs / '++' / '--' / '<-' expr )?
exprs = expr ( ',' expr )*
if_stmt = 'if' ( simplen? ';' )? ( exprn ) block ( 'else' ( if_stmt / block ) )?
simplen = exprsn ( $assign exprsn / '++' / '--' / '<-' exprn )?
exprsn = exprn ( ',' exprn )*
for_stmt = 'for' ( for_range block / for_clause block / exprn block / block )
for_range = ( exprsn ( ':=' / '=' ) )? 'range' exprn
for_clause = simplen? ';' exprn? ';' simplen?
switch_stmt = 'switch' ( simplen? ';' )? ( ( ID ':=' )? postfixn '.' '(' 'type' ')' / type_guard / simplen )? '{' case* '}'
type_guard = ( ID ':=' )? guardn
guardn = primaryn ( sufn )* 
case = ( 'case' ( case_item ( ',' case_item )* ) / 'default' ) ':' stmts
case_item = expr / type
select_stmt = 'select' '{' comm* '}'
comm = ( 'case' simple / 'default' ) ':' stmts
args = '(' ( ( expr / type ) ( ',' ( expr / type ) )* '...'? ','? )? ')'
lit_body = '{' ( element ( ',' element )* ','? )? '}'
element = lit_value ( ':' lit_value )?
lit_value = lit_body / expr
index = '[' ( ( expr / type ) ( ',' ( expr / type ) )* ','? ']' / expr? ':' expr? ( ':' expr )? ']' )
index_or_slice = '[' ':' expr? ( ':' expr )? ']' / '[' expr ':' expr? ( ':' expr )? ']' / '[' ( expr / type ) ( ',' ( expr / type ) )* ','? ']'
lit_type = struct_type / '[' ( '...' / expr )? ']' type / 'map' '[' type ']' type
"""

_GO_EXPR = r"""
@memo expr~ = unary~ ( $binop unary~ )*
unary~ = $unary unary~ / postfix~
postfix~ = primary~ suf~*
suf~ = '.' ID / '.' '(' 'type' ')' / '.' '(' type ')' / index_or_slice / args LITS
primary~ = $lit / 'func' signature block / lit_type ( lit_body / args ) / ID PLAIN / '(' ( expr / type ) ')' / chan_type args / interface_type args / 'func' signature args
"""


def _go_text() -> str:
    a = _GO_EXPR.replace("LITS", "/ lit_body_after").replace("PLAIN", "").replace("~", "")
    b = _GO_EXPR.replace(" LITS", "").replace("PLAIN", "").replace("~", "n")
    # a composite literal may follow a (qualified, instantiated) type name, not in a statement header
    return GO_TEXT + a.replace("lit_body_after", "lit_body") + b


# -- JavaScript and TypeScript -----------------------------------------------------

_JS = re.compile(
    r"""(?P<ws>[ \t\v\f ﻿ -   　]+)|(?P<nl>[\n\r  ]+)|(?P<lc>//[^\n\r  ]*)|(?P<bc>/\*(?s:.*?)\*/)
    |(?P<str>'(?:\\(?:\r\n|[\s\S])|[^'\\\n\r])*'|"(?:\\(?:\r\n|[\s\S])|[^"\\\n\r])*")
    |(?P<num>(?:0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?n?))(?![\w$])
    |(?P<id>[\#@]?(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*)
    |(?P<tpl>`)
    |(?P<op>=>|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|\*\*|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^<>=!?:.,;(){}\[\]~])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[A-Za-z]*")
_TPL = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
_JS_RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let static implements interface package private protected public".split()
)
_JS_CONTEXT = frozenset("async of get set as from type declare namespace module abstract readonly keyof infer is asserts unique global require constructor override out satisfies accessor using string number boolean any never unknown object symbol bigint undefined target meta".split())
_JS_OPERAND = frozenset(["ID", "NUM", "STR", "TPL", "TPLT", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "PRIV", "JSX"]) | _JS_CONTEXT
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b(?!\s*=)|=(?!=)[^>]*>\s*\()")


def _lex_js(text: str, jsx: bool) -> tuple[list[str], list[int], list[bool]]:
    kinds: list[str] = []
    starts: list[int] = []
    newline: list[bool] = []
    stack: list[str] = []
    at, n, match = 0, len(text), _JS.match
    last, nl = "", False
    if text.startswith("#!"):
        m0 = re.search(r"[\n\r]", text)
        at = m0.start() if m0 else n

    def template(p: int, head: bool) -> int:
        """Scans template characters from p; returns where the token ends."""
        nonlocal last
        p = _TPL.match(text, p).end()
        if p >= n:
            raise LexError(n)
        if text[p] == "`":
            last = "TPL" if head else "TPLT"
            return p + 1
        stack.append("$")
        last = "TPLH" if head else "TPLM"
        return p + 2

    while at < n:
        m = match(text, at)
        if m is None:
            raise LexError(n if text.startswith("/*", at) else at)
        kind, end = m.lastgroup, m.end()
        if kind == "ws" or kind == "lc":
            at = end
            continue
        if kind == "nl":
            nl, at = True, end
            continue
        if kind == "bc":
            if "\n" in m.group():
                nl = True
            at = end
            continue
        start = at
        if kind == "op":
            k = m.group()
            if k in ("/", "/="):
                if last not in _JS_OPERAND:
                    r = _REGEX.match(text, at)
                    if r is None:
                        raise LexError(at)
                    k, end = "REGEX", r.end()
            elif k == "{":
                stack.append("{")
            elif k == "}":
                if stack and stack[-1] == "$":
                    stack.pop()
                    end = template(end, False)
                    k = last
                elif stack:
                    stack.pop()
            elif k == "<" and jsx and last not in _JS_OPERAND and not _GENERIC_ARROW.match(text, at):
                stop = _jsx(text, at)
                if stop > 0:
                    k, end = "JSX", stop
            last = k
        elif kind == "id":
            k = m.group()
            if k[0] == "#":
                k = "PRIV"
            elif k[0] == "@":
                k, end = "@", at + 1
            elif k not in _JS_RESERVED and k not in _JS_CONTEXT:
                k = "ID"
            last = "ID" if last in (".", "?.") and k in _JS_RESERVED else k
        elif kind == "tpl":
            end = template(end, True)
            k = last
        else:
            k = last = "NUM" if kind == "num" else "STR"
        kinds.append(k)
        starts.append(start)
        newline.append(nl)
        nl = False
        at = end
    kinds.append("EOF")
    starts.append(n)
    newline.append(True)
    return kinds, starts, newline


_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_JSX_SPACE = re.compile(r"(?:\s|/\*(?s:.*?)\*/|//[^\n]*)*")


def _jsx_braces(text: str, at: int) -> int:
    """End of a `{...}` container: its tokens are balanced and an expression (or a spread, or nothing)."""
    depth, p, n = 0, at, len(text)
    while p < n:
        c = text[p]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                inner = text[at + 1 : p].strip()
                if inner and not re.fullmatch(r"/\*(?s:.*?)\*/", inner):
                    inner = inner[3:] if inner.startswith("...") else inner
                    if failure("tsx", f"({inner}\n);") is not None:
                        return -1
                return p + 1
        elif c in "\"'`":
            q = p + 1
            while q < n and text[q] != c:
                q += 2 if text[q] == "\\" else 1
            p = q
        elif text.startswith("/*", p):
            q = text.find("*/", p + 2)
            if q < 0:
                return -1
            p = q + 1
        elif text.startswith("//", p):
            q = text.find("\n", p)
            if q < 0:
                return -1
            p = q
        p += 1
    return -1


def _jsx(text: str, at: int) -> int:
    """End of the JSX element that begins at `at`, or -1."""
    p = at + 1
    p = _JSX_SPACE.match(text, p).end()
    name = _JSX_NAME.match(text, p)
    tag = name.group() if name else ""
    p = name.end() if name else p
    while True:  # attributes
        p = _JSX_SPACE.match(text, p).end()
        if text.startswith("/>", p):
            return p + 2 if tag else -1
        if text.startswith(">", p):
            p += 1
            break
        if text.startswith("{", p) and tag:
            p = _jsx_braces(text, p)
            if p < 0:
                return -1
            continue
        a = _JSX_NAME.match(text, p)
        if a is None or not tag:
            return -1
        p = _JSX_SPACE.match(text, a.end()).end()
        if text.startswith("=", p):
            p = _JSX_SPACE.match(text, p + 1).end()
            c = text[p : p + 1]
            if c in ('"', "'"):
                q = text.find(c, p + 1)
                if q < 0:
                    return -1
                p = q + 1
            elif c == "{":
                p = _jsx_braces(text, p)
            elif c == "<":
                p = _jsx(text, p)
            else:
                return -1
            if p < 0:
                return -1
    while True:  # children
        m = re.compile(r"[<{}>]").search(text, p)
        if m is None or m.group() in "}>":
            return -1
        p = m.start()
        if m.group() == "{":
            p = _jsx_braces(text, p)
            if p < 0:
                return -1
            continue
        close = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(text, p)
        if close:
            return close.end() if close.group(1) == tag else -1
        p = _jsx(text, p)
        if p < 0:
            return -1


JS_TEXT = r"""
file = item* EOF
$name : ID async of get set as from type declare namespace module abstract readonly keyof infer is asserts unique global require constructor override out satisfies accessor using string number boolean any never unknown object symbol bigint undefined target meta
$word : $name break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield await let static implements interface package private protected public
$assign : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=
$binop : || && ?? | & ^ == != === !== < <= << + - * / % ** instanceof
$unary : delete void typeof + - ~ !
$atom : $name NUM STR TPL REGEX this null true false super
semi = ';' / &'}' / NL / &EOF
item = import_decl / export_decl / stmt
import_decl = 'import' !( '(' / '.' ) ( STR attrs? semi / «'type' ( import_clause ) 'from' STR attrs? semi / » import_clause 'from' STR attrs? semi « / 'type'? $name '=' ( 'require' '(' STR ')' / dotted ) semi » )
import_clause = star_as / named_imports / $name !( '=' ) ( ',' ( star_as / named_imports ) )?
star_as = '*' 'as' $name
named_imports = '{' ( import_spec ( ',' import_spec )* ','? )? '}'
import_spec = «'type' ( $word / STR ) 'as' $name / 'type' !( 'as' / ',' / '}' ) $name / » ( $word / STR ) 'as' $name / $name
attrs = ( 'with' / NONL 'assert_' ) '{' ( ( $word / STR ) ':' STR ( ',' ( $word / STR ) ':' STR )* ','? )? '}'
export_decl = decorator* 'export' ( 'default' export_default / «'type'» '*' ( 'as' ( $word / STR ) )? 'from' STR attrs? semi / '*' ( 'as' ( $word / STR ) )? 'from' STR attrs? semi / «'type' named_exports ( 'from' STR attrs? )? semi / » named_exports ( 'from' STR attrs? )? semi « / '=' expr semi / 'as' 'namespace' $name semi / 'import' 'type'? $name '=' ( 'require' '(' STR ')' / dotted ) semi » / decl )
named_exports = '{' ( export_spec ( ',' export_spec )* ','? )? '}'
export_spec = «'type' !( 'as' / ',' / '}' ) ( $word / STR ) ( 'as' ( $word / STR ) )? / » ( $word / STR ) ( 'as' ( $word / STR ) )?
export_default = function_decl / decorator* class_decl « / 'abstract' class_decl / interface_decl » / assign semi
decl = function_decl / decorator* class_decl / var_decl semi « / decorator* 'abstract' class_decl / interface_decl / type_alias / enum_decl / namespace_decl / 'declare' NONL declare_body »
«declare_body = function_decl / 'abstract'? class_decl / var_decl semi / interface_decl / type_alias / enum_decl / namespace_decl / 'global' block_items»
dotted = $name ( '.' $word )*
decorator = '@' ( '(' expr ')' / $name ( '.' $word )* «type_args?» args? ( '.' $word )* args? )
args = '(' ( arg ( ',' arg )* ','? )? ')'
arg = '...'? assign
«interface_decl = 'interface' $name type_params? ( 'extends' type_ref ( ',' type_ref )* )? object_type
type_alias = 'type' NONL $name type_params? '=' type semi
enum_decl = 'const'? 'enum' $name '{' ( enum_member ( ',' enum_member )* ','? )? '}'
enum_member = ( $word / STR / '[' assign ']' / TPL ) ( '=' assign )?
namespace_decl = ( 'namespace' / 'module' ) NONL ( dotted / STR ) ( block_items / semi )
block_items = '{' item* '}'»
var_decl = ( 'var' / 'const' !'enum' / 'let' ) binding ( ',' binding )*
var_declin = ( 'var' / 'const' / 'let' ) bindingin ( ',' bindingin )*
binding = target «'!'? type_ann?» ( '=' assign )?
bindingin = target «type_ann?» ( '=' assignin )?
target = $name / array_pattern / object_pattern
array_pattern = '[' ','* ( '...' target / target ( '=' assign )? )? ( ','+ ( '...' target / target ( '=' assign )? ) )* ','* ']'
object_pattern = '{' ( prop_pattern ( ',' prop_pattern )* ','? )? '}'
prop_pattern = '...' target / prop_name ':' target ( '=' assign )? / $name ( '=' assign )?
prop_name = $word / STR / NUM / '[' assign ']' / PRIV
function_decl = 'async' NONL 'function' '*'? $name? fn_rest / 'function' '*'? $name? fn_rest
fn_rest = «type_params?» params «return_type?» ( blockf « / semi » )
params = '(' ( param ( ',' param )* ','? )? ')'
param = decorator* «modifier*» ( «'this' type_ann? / » '...'? target «'?'? type_ann?» ( '=' assign )? )
«modifier = ( 'public' / 'private' / 'protected' / 'readonly' / 'override' ) !( ',' / ')' / ':' / '=' / '?' )»
class_decl = 'class' ( !( 'extends' / 'implements' ) $name )? «type_params?» ( 'extends' heritage )? «( 'implements' type_ref ( ',' type_ref )* )?» '{' member* '}'
heritage = call_chain «type_args?»
member = ';' / 'static' blockf / decorator* member_mods ( accessor_member / method / index_sig_member / field )
member_mods = ( ( 'static' «/ 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare' » / 'accessor' ) !( '(' / '=' / ';' / '}' / ':' / '?' / '!' / '<' ) NONL )*
index_sig_member = «'[' $name ':' type ']' type_ann semi» NEVER
accessor_member = ( 'get' / 'set' ) !( '(' / '=' / ';' / '}' / ':' / '?' / '<' / '!' ) prop_name fn_rest
method = 'async' !( '(' / '=' / ';' / ':' / '?' ) NONL '*'? prop_name «'?'?» method_rest / '*'? prop_name «'?'?» method_rest
method_rest = «type_params?» params «return_type?» ( blockf « / semi » )
field = prop_name «( '?' / '!' )? type_ann?» ( '=' assign )? semi
@memo arrow = 'async' NONL $name NONL '=>' arrow_body / $name NONL '=>' arrow_body / ( 'async' NONL )? «type_params?» params «return_type?» NONL '=>' arrow_body
arrow_body = blockf / !'{' assign
@memo arrowin = 'async' NONL $name NONL '=>' arrow_bodyin / $name NONL '=>' arrow_bodyin / ( 'async' NONL )? params NONL '=>' arrow_bodyin
arrow_bodyin = blockf / !'{' assignin
expr = assign ( ',' assign )*
exprin = assignin ( ',' assignin )*
spread_list = ','* ( '...'? assign )? ( ','+ '...'? assign )* ','*
object = '{' ( property ( ',' property )* ','? )? '}'
property = '...' assign / ( 'get' / 'set' ) !( '(' / ':' / ',' / '}' / '=' / '<' ) prop_name fn_rest_body / 'async' NONL !( '(' / ':' / ',' / '}' / '=' / '<' ) '*'? prop_name fn_rest_body / '*' prop_name fn_rest_body / prop_name ':' assign / prop_name fn_rest_body / $name ( '=' assign )?
fn_rest_body = «type_params?» params «return_type?» blockf
template = TPL / TPLH expr ( TPLM expr )* TPLT
primary = arrow / function_expr / class_expr / $atom / template / '[' spread_list ']' / object / '(' expr ')' / 'import' ( '(' assign ( ',' assign )? ','? ')' / '.' $name ) / new_expr / PRIV &'in' / '@' NEVER JSXALT
function_expr = 'async' NONL 'function' '*'? $name? fn_rest_body / 'function' '*'? $name? fn_rest_body
class_expr = decorator* class_decl
new_expr = 'new' ( '.' 'target' / new_callee «type_args?» args? )
new_callee = ( new_expr / function_expr / class_expr / $atom / template / '[' spread_list ']' / object / '(' expr ')' / 'import' '.' $name ) ( '.' ( $word / PRIV ) / '[' expr ']' / template « / NONL '!' » )*
call_chain = primary chain*
chain = '.' ( $word / PRIV ) / '?.' ( args / '[' expr ']' / $word / PRIV « / type_args args » ) / '[' expr ']' / args / template « / NONL '!' !'=' / type_args &( '(' / TPL / TPLH / ')' / ']' / ',' / ';' / '.' ) »
gt_op = '>' '>'? '>'? '='?
«type_ann = ':' type
return_type = ':' ( 'asserts' ( $name / 'this' ) ( 'is' type )? / ( $name / 'this' ) 'is' type / type )
type_params = '<' type_param ( ',' type_param )* ','? '>'
type_param = ( 'const' / 'in' / 'out' )* $name ( 'extends' type )? ( '=' type )?
type_args = '<' type ( ',' type )* ','? '>'
@memo type = fn_type / cond_type
fn_type = 'abstract'? 'new'? type_params? params '=>' ( return_pred / type )
return_pred = 'asserts' ( $name / 'this' ) ( 'is' type )? / ( $name / 'this' ) 'is' type
cond_type = union_type ( NONL 'extends' union_type '?' type ':' type )?
union_type = '|'? inter_type ( '|' inter_type )*
inter_type = '&'? unary_type ( '&' unary_type )*
unary_type = ( 'keyof' / 'unique' / 'readonly' ) !( ')' / ',' / ';' / '=' / '|' / '&' / '>' / ']' / '}' / EOF ) unary_type / 'infer' $name ( 'extends' union_type !'?' )? / fn_type / array_type
array_type = prim_type ( NONL '[' type? ']' )*
prim_type = '(' type ')' / tuple_type / mapped_type / object_type / TPL / TPLH type ( TPLM type )* TPLT / STR / '-'? NUM / 'true' / 'false' / 'null' / 'void' / 'this' / 'typeof' ( 'import' '(' STR ')' ( '.' $word )* / 'this' ( '.' $word )* / $name ( '.' ( $word / PRIV ) )* ) ( NONL type_args )? / 'import' '(' STR ( ',' object )? ')' ( '.' $word )* type_args? / type_ref
type_ref = $name ( '.' $word )* ( NONL type_args )?
tuple_type = '[' ( tuple_elem ( ',' tuple_elem )* ','? )? ']'
tuple_elem = '...' $name '?'? ':' type / $word '?'? ':' type / '...' type / type '?'?
mapped_type = '{' ( ( '+' / '-' )? 'readonly' )? '[' $name 'in' type ( 'as' type )? ']' ( ( '+' / '-' )? '?' )? type_ann? ';'? '}'
object_type = '{' type_member* '}'
type_member = ( call_sig / ( 'get' / 'set' ) !( '(' / ':' / '?' / '<' / ',' / ';' ) prop_name params return_type? / 'readonly'? '[' $name ':' type ']' type_ann / 'readonly' !( '(' / ':' / '?' / '<' ) prop_name '?'? type_ann? / 'readonly'? prop_name '?'? ( type_params? params return_type? / type_ann? ) ) ( ';' / ',' / NL / &'}' )
call_sig = 'new'? type_params? params return_type? »
"""

_JS_EXPR = r"""
assign~ = arrow! / yield~ / cond~ ( ( $assign / gt_assign ) assign~ )?
yield~ = 'yield' ( NONL '*' assign~ / NONL !( ')' / ']' / '}' / ',' / ';' / ':' ) assign~ )?
cond~ = binary~ ( '?' assign ':' assign~ )?
binary~ = unary~ ( OPS unary~ « / NONL ( 'as' / 'satisfies' ) ( 'const' / type ) » )*
unary~ = ( $unary / '++' / '--' / 'await' )* postfix~ « / '<' type '>' unary~ »
postfix~ = call_chain ( NONL ( '++' / '--' ) )?
"""

_JS_STMT = r"""
block~ = '{' stmt~* '}'
stmt~ = block~ / ';' / if~ / for~ / while~ / do~ / switch~ / try~ / 'continue' ( NONL $name )? semi / 'break' ( NONL $name )? semi / RETURN 'throw' NONL expr semi / 'debugger' semi / 'import' &( '(' / '.' ) NEVER / declaration / labelled~ / expr_stmt
declaration = function_decl / decorator* class_decl / var_decl semi « / decorator* 'abstract' NONL class_decl / interface_decl / type_alias / enum_decl / namespace_decl / 'declare' NONL declare_body »
labelled~ = $name ':' stmt~
expr_stmt = !( 'function' / 'class' / '{' / 'let' '[' ) expr semi
if~ = 'if' '(' expr ')' stmt~ ( 'else' stmt~ )?
while~ = 'while' '(' expr ')' stmt~
do~ = 'do' stmt~ 'while' '(' expr ')' ';'?
for~ = 'for' 'await'? '(' ( for_each / for_three ) ')' stmt~
for_each = ( ( 'var' / 'const' / 'let' ) target «type_ann?» / call_chain ) ( 'of' assign / 'in' expr )
for_three = ( var_declin / exprin )? ';' expr? ';' expr?
switch~ = 'switch' '(' expr ')' '{' ( ( 'case' expr / 'default' ) ':' stmt~* )* '}'
try~ = 'try' block~ ( 'catch' ( '(' target «type_ann?» ')' )? block~ ( 'finally' block~ )? / 'finally' block~ )
"""


def _js_text(typed: bool, jsx: bool) -> str:
    out = JS_TEXT.replace("NEVER JSXALT", "NEVER" + (" / JSX" if jsx else ""))
    out += "\ngt_assign = '>' '>' '>'? '='\n"
    for suffix in ("", "in"):
        t = _JS_EXPR.replace("arrow!", "arrow" + suffix).replace("OPS", "( $binop / !gt_assign gt_op )" if suffix else "( $binop / 'in' / !gt_assign gt_op )")
        if jsx:
            t = t.replace("« / '<' type '>' unary~ »", "")
        out += t.replace("~", suffix)
    stmts = _JS_STMT.replace("RETURN", "").replace("~", "")
    inner = "\n".join(x for x in _JS_STMT.replace("RETURN", "'return' ( NONL expr )? semi /").split("\n") if "~" in x.split("=")[0]).replace("~", "f")
    out += stmts + inner
    if typed:
        return out.replace("«", "").replace("»", "")
    out = re.sub(r"«[^«»]*»", "", out)
    # what the typed parts leave behind
    out = re.sub(r"=\s*/ ", "= ", out)
    return out


def lex_js(text: str) -> tuple[list[str], list[int], list[bool]]:
    return _lex_js(text, False)


def lex_tsx(text: str) -> tuple[list[str], list[int], list[bool]]:
    return _lex_js(text, True)


_LEX = {"rust": lex_rust, "go": lex_go, "javascript": lex_js, "typescript": lex_js, "tsx": lex_tsx}
_TEXTS = {"rust": _rust_text, "go": _go_text, "javascript": lambda: _js_text(False, False), "typescript": lambda: _js_text(True, False), "tsx": lambda: _js_text(True, True)}
_made: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    if language not in _made:
        _made[language] = Grammar(_TEXTS[language]())
    return _made[language]


class TooDeep(Exception):
    """The text nests deeper than it can be parsed: nothing is known of it."""


def _python(text: str) -> int | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<file>", "exec", dont_inherit=True)
    except SyntaxError as e:
        if "too many nested" in (e.msg or ""):
            raise TooDeep from e
        lines = text.split("\n")
        row = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
        return min(sum(len(x) + 1 for x in lines[:row]) + max((e.offset or 1) - 1, 0), len(text))
    except ValueError:  # null bytes
        return max(text.find("\0"), 0)
    except (RecursionError, MemoryError, OverflowError) as e:
        raise TooDeep from e
    return None


def failure(language: str, text: str) -> int | None:
    """None if the text is valid, else the offset of the furthest failure; TooDeep where neither can be told."""
    if text.startswith("﻿"):
        bad = failure(language, text[1:])
        return None if bad is None else bad + 1
    if language == "python":
        return _python(text)
    g = grammar(language)
    try:
        kinds, starts, newline = _LEX[language](text)
    except LexError as e:
        return e.at
    if len(kinds) == 1 or (language == "go" and kinds == [";", "EOF"]):
        return None
    limit = sys.getrecursionlimit()
    try:
        for deep in (limit, max(limit, 100 * len(kinds) + 10_000)):  # calls between Python functions take no native stack
            sys.setrecursionlimit(deep)
            try:
                return None if g.accepts(kinds, newline) else starts[g.furthest(kinds, newline)]
            except RecursionError:
                continue
        raise TooDeep
    except MemoryError as e:
        raise TooDeep from e
    finally:
        sys.setrecursionlimit(limit)

"""Grammars over token kinds, for parsing with derivatives. The first rule is the start."""

JSON = """
file = value ;
value = 'string' | 'number' | 'word' | object | array ;
object = '{' (pair (',' pair)*)? '}' ;
pair = 'string' ':' value ;
array = '[' (value (',' value)*)? ']' ;
"""

PYTHON = """
file = stmt* ;
stmt = simple | compound ;
simple = small (';' small)* ';'? 'NEWLINE' ;
name = 'NAME' | 'match' | 'case' | 'type' ;
small = exprs ( 'aug' yexprs | ('=' yexprs)+ | ':' expr ('=' yexprs)? )? | yield | 'del' exprs | 'pass' | 'break' | 'continue' | 'return' exprs?
  | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') name (',' name)* | 'assert' expr (',' expr)? | 'import' dotted_as (',' dotted_as)*
  | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | '(' as_name (',' as_name)* ','? ')' | as_name (',' as_name)*)
  | 'type' name tparams? '=' expr ;
dotted = name ('.' name)* ;
dotted_as = dotted ('as' name)? ;
as_name = name ('as' name)? ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ('*' | '**')? name (':' expr)? ('=' expr)? ;
yield = 'yield' ('from' expr | exprs)? ;
yexprs = yield | exprs ;
exprs = sexpr (',' sexpr)* ','? ;
sexpr = '*' expr | expr ;
named = name ':=' expr | expr ;
snamed = '*' expr | named ;
expr = flat ('if' flat 'else' expr)? | 'lambda' lparams? ':' expr ;
flat = operand (binop operand)* ;
binop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '^' | '|' | '<' | '>' | '==' | '!=' | '<=' | '>=' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? ;
operand = ('+' | '-' | '~' | 'not' | 'await')* atom trailer* ;
trailer = '.' name | '(' args? ')' | '[' subscript (',' subscript)* ','? ']' ;
subscript = snamed | expr? ':' expr? (':' expr?)? ;
args = arg (',' arg)* ','? ;
arg = named comp? | name '=' expr | '*' expr | '**' expr ;
comp = ('async'? 'for' targets 'in' flat ('if' cond)*)+ ;
cond = flat ;
targets = target (',' target)* ','? ;
target = '*'? atom trailer* ;
atom = name | 'NUMBER' | 'STRING'+ | '...' | 'None' | 'True' | 'False' | '(' (yield | snamed (comp | (',' snamed)* ','?))? ')'
  | '[' (snamed (comp | (',' snamed)* ','?))? ']' | '{' (item (comp | (',' item)* ','?))? '}' ;
item = snamed (':' expr)? | '**' expr ;
lparams = lparam (',' lparam)* ','? ;
lparam = name ('=' expr)? | '*' name? | '**' name | '/' ;
params = param (',' param)* ','? ;
param = name (':' expr)? ('=' expr)? | '*' (name (':' sexpr)?)? | '**' name (':' expr)? | '/' ;
suite = ':' (simple | 'NEWLINE' 'INDENT' stmt+ 'DEDENT') ;
compound = 'if' named suite ('elif' named suite)* ('else' suite)? | 'while' named suite ('else' suite)? | 'async'? 'for' targets 'in' exprs suite ('else' suite)?
  | 'try' suite (('except' '*'? (exprs ('as' name)?)? suite)+ ('else' suite)? ('finally' suite)? | 'finally' suite)
  | 'async'? 'with' withs suite | ('@' named 'NEWLINE')* ('async'? 'def' name tparams? '(' params? ')' ('->' exprs)? suite | 'class' name tparams? ('(' args? ')')? suite)
  | 'match' exprs_m ':' 'NEWLINE' 'INDENT' ('case' patterns ('if' named)? suite)+ 'DEDENT' ;
exprs_m = snamed (',' snamed)* ','? ;
withs = with (',' with)* | '(' with (',' with)* ','? ')' ;
with = expr ('as' target)? ;
patterns = pattern (',' pattern)* ','? ;
pattern = closed ('|' closed)* ('as' name)? | '*' name ;
closed = '-'? 'NUMBER' (('+' | '-') 'NUMBER')? | 'STRING'+ | 'None' | 'True' | 'False' | name ('.' name)* ('(' (pattern_arg (',' pattern_arg)* ','?)? ')')?
  | '(' patterns? ')' | '[' patterns? ']' | '{' (pair_p (',' pair_p)* ','?)? '}' ;
pattern_arg = name '=' pattern | pattern ;
pair_p = closed ':' pattern | '**' name ;
"""

# $TYPE, $TPARAMS and the like are empty in the plain language.
_ECMA = """
file = item* ;
item = import | export | stmt ;
semi = ';' | 'ASI' ;
id = 'ident' | 'of' | 'async' | 'get' | 'set' | 'from' | 'as' | 'target' | 'await' | 'static' @ID@ ;
name = id | 'kw' | 'const' | 'new' | 'import' | 'export' | 'default' | 'this' | 'super' | 'null' | 'bool' | 'function' | 'class' | 'extends' | 'return' | 'if' | 'else' | 'for' | 'in' | 'while' | 'do'
  | 'switch' | 'case' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'var' | 'let' | 'typeof' | 'yield' | 'instanceof' | 'debugger' | 'with' | 'enum' @NAME@ ;
import = 'import' ( 'string' attrs? semi | @TYPEONLY@ clause 'from' 'string' attrs? semi @IMPORTEQ@ ) ;
attrs = 'with' object ;
clause = id (',' (ns | named))? | ns | named ;
ns = '*' 'as' id ;
named = '{' (spec (',' spec)* ','?)? '}' ;
spec = @TYPEONLY@ (name ('as' name)? | 'string' 'as' name) ;
export = 'export' ( @TYPEONLY@ ('*' ('as' (name | 'string'))? 'from' 'string' attrs? semi | exnamed ('from' 'string' attrs?)? semi) | 'default' (func | class | expr1 semi @EXDEF@) | decl @EXPORT@ ) ;
exnamed = '{' (exspec (',' exspec)* ','?)? '}' ;
exspec = @TYPEONLY@ (name | 'string') ('as' (name | 'string'))? ;
decl = func | class | ('var' | 'let' | 'const') vars semi @DECL@ ;
vars = var (',' var)* ;
var = binding @BANG@ ('=' assign)? ;
binding = (id | '[' (bindel? ',')* bindel? ']' | '{' (bindprop (',' bindprop)* ','?)? '}') ;
bindel = '...'? binding ('=' assign)? ;
bindprop = '...' id | id ('=' assign)? | propname ':' binding ('=' assign)? ;
block = '{' stmt* '}' ;
stmt = block | decl | ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'for' 'await'? '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' (';' | 'ASI')?
  | ('continue' | 'break') id? semi | 'return' expr? semi | 'switch' '(' expr ')' '{' ('case' expr ':' stmt* | 'default' ':' stmt*)* '}' | 'throw' expr semi
  | 'try' block ('catch' ('(' binding @ANN@ ')')? block ('finally' block)? | 'finally' block) | id ':' stmt | 'debugger' semi | expr1 semi ;
forhead = (('var' | 'let' | 'const') vars | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') binding | operand) ('of' assign | 'in' expr) ;
expr = assign (',' assign)* ;
expr1 = assign1 (',' assign)* ;
assign = arrow | 'yield' ('*'? assign)? | operand rest ;
assign1 = arrow | 'yield' ('*'? assign)? | operand1 rest ;
rest = ('=' | 'asg') assign | (binop operand @ASTYPE@)* ('?' assign ':' assign)? ;
arrow = 'async'? ((id | @TPARAMS@ '(' params ')' @RET@) '=>' (assign_nb | '{' stmt* '}')) ;
assign_nb = arrow | 'yield' ('*'? assign)? | operandb rest ;
binop = '+' | '-' | '*' | 'op' | '<' | '>' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' | '/' | '&' | '|' ;
prefix = '+' | '-' | 'pre' | '++' | 'typeof' | 'new' | 'await' @CAST@ ;
operand = prefix* primary suffix* '++'? ;
operand1 = prefix+ primary suffix* '++'? | primary1 suffix* '++'? ;
operandb = prefix+ primary suffix* '++'? | (primary1 | func | class) suffix* '++'? ;
suffix = '.' (name | 'private') | '?.' (name | 'private' | '[' expr ']' | args @TARGS_Q@) | '[' expr ']' | args | template @SUFFIX@ ;
args = '(' (arg (',' arg)* ','?)? ')' ;
arg = '...'? assign ;
primary = primary1 | object | func | class ;
primary1 = id | 'number' | 'string' | 'regex' | template | 'this' | 'super' | 'null' | 'bool' | '(' expr ')' | '[' (arg? ',')* arg? ']' | 'import' ('(' assign (',' assign)? ','? ')' | '.' id) | 'new' '.' 'target' | 'private' ;
template = 'tpl' | 'tpl(' expr ('tpl-' expr)* 'tpl)' ;
object = '{' (prop (',' prop)* ','?)? '}' ;
prop = '...' assign | propname ':' assign | id ('=' assign)? | ('async' | 'get' | 'set')? '*'? propname method ;
propname = name | 'string' | 'number' | '[' assign ']' | 'private' ;
method = @TPARAMS@ '(' params ')' @RET@ block ;
params = (param (',' param)* ','?)? ;
param = decorator* @PMODS@ '...'? binding @OPT@ ('=' assign)? @THISPARAM@ ;
func = 'async'? 'function' '*'? id? @TPARAMS@ '(' params ')' @RET@ @BODY@ ;
decorator = '@' (id ('.' name)* args? | '(' expr ')') ;
class = decorator* @ABSTRACT@ 'class' id? @TPARAMS@ ('extends' primary suffix* @HERITAGE@)? @IMPLEMENTS@ '{' member* '}' ;
member = ';' | 'static' block | decorator* @MMODS@ ('static' | 'async' | 'get' | 'set')* '*'? propname @MOPT@ ( @TPARAMS@ '(' params ')' @RET@ @BODY@ | @FANN@ ('=' assign)? semi ) @MEMBER@ ;
"""

_TYPES = """
tword = 'type' | 'interface' | 'declare' | 'namespace' | 'module' | 'abstract' | 'readonly' | 'keyof' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'unique' | 'implements' | 'public' | 'private_' | 'protected' | 'override' | 'accessor' | 'out' | 'global' ;
ann = ':' type ;
ret = ':' ('asserts'? (id | 'this') ('is' type)? | type) ;
tparams = '<' tparam (',' tparam)* ','? '>' ;
tparam = ('const' | 'in' | 'out')* id ('extends' type)? ('=' type)? ;
targs = '<' type (',' type)* ','? '>' ;
type = union ('extends' union '?' type ':' type)? | 'abstract'? 'new'? tparams? '(' params ')' '=>' ret_type ;
ret_type = 'asserts'? (id | 'this') ('is' type)? | type ;
union = '|'? inter ('|' inter)* ;
inter = '&'? tpost ('&' tpost)* ;
tpost = ('keyof' | 'unique' | 'readonly' | 'infer')* tprim ('[' type? ']')* ;
tprim = (id | 'void') ('.' name)* targs? | 'string' | '-'? 'number' | 'bool' | 'null' | 'this' | template_t | 'typeof' (id | 'this' | 'import' '(' 'string' ')') ('.' name)* targs?
  | '{' tmember* '}' | mapped | '[' (telem (',' telem)* ','?)? ']' | '(' type ')' | 'import' '(' 'string' ')' ('.' name)* targs? ;
mapped = '{' (('+' | '-')? 'readonly')? '[' id 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? (';' | ',')? '}' ;
template_t = 'tpl' | 'tpl(' type ('tpl-' type)* 'tpl)' ;
telem = '...'? (id '?'? ':')? type '?'? ;
tmember = ( ('new')? tparams? '(' params ')' ret? | 'readonly'? '[' id ':' type ']' ann? | ('readonly' | 'get' | 'set')* propname '?'? (tparams? '(' params ')' ret? | ann?) ) (';' | ',' | 'ASI') ;
interface = 'interface' id tparams? ('extends' tref (',' tref)*)? '{' tmember* '}' ;
tref = id ('.' name)* targs? ;
alias = 'type' id tparams? '=' type semi ;
enum = 'const'? 'enum' id '{' (enumel (',' enumel)* ','?)? '}' ;
enumel = (name | 'string') ('=' assign)? ;
space = ('namespace' | 'module' | 'global') (id ('.' id)* | 'string')? (block_d | semi) ;
block_d = '{' item* '}' ;
"""


def _ecma(slots: dict[str, str]) -> str:
    import re

    return re.sub(r"@(\w+)@", lambda m: slots.get(m[1], ""), _ECMA)


JAVASCRIPT = _ecma({"BODY": "block"})

TYPESCRIPT = _ecma(
    {
        "ID": "| tword", "NAME": "| 'void' | 'private_'", "TYPEONLY": "'type'?", "IMPORTEQ": "| 'type'? id '=' ('ident' '(' 'string' ')' | id ('.' name)*) semi",
        "EXDEF": "| interface", "EXPORT": "| '=' expr semi | 'as' 'namespace' id semi", "DECL": "| interface | alias | enum | space | 'declare' decl",
        "BANG": "'pre'? ann?", "ANN": "ann?", "ASTYPE": "| ('as' | 'satisfies') (type | 'const')", "TPARAMS": "tparams?", "RET": "ret?", "CAST": "| '<' type '>'",
        "TARGS_Q": "| targs args", "SUFFIX": "| 'pre' | targs args | targs template", "PMODS": "('public' | 'private_' | 'protected' | 'readonly' | 'override')*", "OPT": "'?'? ann?",
        "THISPARAM": "| 'this' ann", "BODY": "(block | semi)", "ABSTRACT": "'abstract'?", "HERITAGE": "targs?", "IMPLEMENTS": "('implements' tref (',' tref)*)?",
        "MMODS": "('public' | 'private_' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor')*", "MOPT": "('?' | 'pre')?", "FANN": "ann?",
        "MEMBER": "| ('static' | 'readonly')* '[' id ':' type ']' ann semi",
    }
) + _TYPES

PHP = """
file = top* ;
top = stmt | 'namespace' (qname? ('{' top* '}' | semi)) | 'use' ('function' | 'const')? use (',' use)* semi | 'const' const (',' const)* semi | '__halt' '(' ')' semi ;
semi = ';' | 'html' ;
use = qname ('as' id)? | qname_b '{' usein (',' usein)* ','? '}' ;
usein = ('function' | 'const')? qname ('as' id)? ;
id = 'ident' | 'enum' | 'readonly' | 'from' | 'self' | 'match_' ;
name = id | 'kw' | 'namespace' | 'use' | 'function' | 'const' | 'fn' | 'class' | 'abstract' | 'final' | 'interface' | 'trait' | 'extends' | 'implements' | 'public' | 'private' | 'protected' | 'static' | 'var' | 'new' | 'clone'
  | 'if' | 'else' | 'elseif' | 'endif' | 'while' | 'endwhile' | 'do' | 'for' | 'endfor' | 'foreach' | 'endforeach' | 'switch' | 'endswitch' | 'case' | 'default' | 'match' | 'break' | 'continue' | 'return' | 'try' | 'catch' | 'finally'
  | 'throw' | 'global' | 'echo' | 'print' | 'unset' | 'isset' | 'empty' | 'list' | 'array' | 'callable' | 'as' | 'instanceof' | 'wordop' | 'yield' | 'include' | 'declare' | 'goto' | 'exit' | 'insteadof' | '__halt' ;
qname = 'qname' | id ;
qname_b = 'qname_b' ;
const = id '=' expr ;
attrs = ('#[' attr (',' attr)* ','? ']')* ;
attr = tname args? ;
tname = qname | 'static' ;
type = '?'? tatom | tunion ('|' tunion)* | tatom ('amp' tatom)* ;
tunion = tatom | '(' tatom ('amp' tatom)+ ')' ;
tatom = qname | 'array' | 'callable' | 'static' | 'null' ;
params = (param (',' param)* ','?)? ;
param = attrs ('public' | 'private' | 'protected' | 'readonly')* type? 'amp'? '...'? 'var$' ('=' expr)? ('{' hook* '}')? ;
hook = attrs 'final'? 'amp'? id ('(' params ')')? ('=>' expr ';' | block | ';') ;
block = '{' stmt* '}' ;
args = '(' ('...' | arg (',' arg)* ','?)? ')' ;
arg = '...'? expr | name ':' expr ;
stmt = 'html' | ';' | block | 'if' '(' expr ')' (stmt ('elseif' '(' expr ')' stmt)* ('else' stmt)? | ':' stmt* ('elseif' '(' expr ')' ':' stmt*)* ('else' ':' stmt*)? 'endif' semi)
  | 'while' '(' expr ')' (stmt | ':' stmt* 'endwhile' semi) | 'do' stmt 'while' '(' expr ')' semi | 'for' '(' exprs? ';' exprs? ';' exprs? ')' (stmt | ':' stmt* 'endfor' semi)
  | 'foreach' '(' expr 'as' fetarget ('=>' fetarget)? ')' (stmt | ':' stmt* 'endforeach' semi) | 'switch' '(' expr ')' ('{' ';'? cases '}' | ':' cases 'endswitch' semi)
  | ('break' | 'continue') 'number'? semi | 'return' expr? semi | 'global' var (',' var)* semi | 'static' svar (',' svar)* semi | 'echo' exprs semi | 'echo=' exprs semi | 'unset' '(' exprs ','? ')' semi
  | 'try' block ('catch' '(' qname ('|' qname)* 'var$'? ')' block)* ('finally' block)? | 'declare' '(' const (',' const)* ')' (semi | stmt) | 'goto' id semi | id ':'
  | attrs (func | classdecl) | expr semi ;
cases = ('case' expr (':' | ';') stmt* | 'default' (':' | ';') stmt*)* ;
fetarget = 'amp'? expr ;
svar = 'var$' ('=' expr)? ;
exprs = expr (',' expr)* ;
func = 'function' 'amp'? name '(' params ')' (':' type)? block ;
classdecl = ('abstract' | 'final' | 'readonly')* 'class' id ('extends' qname)? ('implements' qname (',' qname)*)? body | 'interface' id ('extends' qname (',' qname)*)? body | 'trait' id body
  | 'enum' id (':' type)? ('implements' qname (',' qname)*)? body ;
body = '{' member* '}' ;
member = 'use' qname (',' qname)* (semi | '{' rule* '}') | attrs mods ( 'const' type? cname '=' expr (',' cname '=' expr)* semi | 'function' 'amp'? name '(' params ')' (':' type)? (block | semi) | type? prop (',' prop)* (semi | '{' hook* '}') )
  | attrs 'case' name ('=' expr)? semi ;
cname = name ;
rule = (qname '::')? name ('as' ('public' | 'private' | 'protected')? name? | 'insteadof' qname (',' qname)*) ';' ;
mods = ('public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'readonly' | 'var')* ;
prop = 'var$' ('=' expr)? ;
expr = operand (binop operand | '?' expr? ':' operand | 'instanceof' (tname | operand))* ;
binop = '+' | '-' | '*' | 'op' | 'amp' | '|' | '=' 'amp'? | 'asg' | 'wordop' | '.' ;
prefix = '+' | '-' | 'pre' | '++' | 'cast' | 'amp' | 'clone' | 'print' | 'include' | 'throw' | 'yield_from' ;
operand = prefix* primary suffix* '++'? | 'yield' (expr ('=>' expr)?)? | 'fn_expr' | prefix* closure ;
closure = attrs 'static'? ('function' 'amp'? '(' params ')' ('use' '(' (usevar (',' usevar)* ','?)? ')')? (':' type)? block | 'fn' 'amp'? '(' params ')' (':' type)? '=>' expr) suffix* ;
usevar = 'amp'? 'var$' ;
var = 'var$' | '$' (var | '{' expr '}') ;
primary = var | 'number' | 'string' | istring | 'null' | qname | 'static' | 'array' '(' items ')' | '[' items ']' | 'list' '(' items ')' | '(' expr ')' | 'isset' '(' exprs ','? ')' | 'empty' '(' expr ')' | 'exit' ('(' expr? ')')?
  | 'new' newwhat | 'match' '(' expr ')' '{' (arm (',' arm)* ','?)? '}' | 'callable' ;
newwhat = (tname | var newsuffix* | '(' expr ')') args? | attrs 'readonly'? 'class' args? ('extends' qname)? ('implements' qname (',' qname)*)? body ;
newsuffix = ('->' | '?->') (name | var) | '::' var | '[' expr ']' ;
arm = (expr (',' expr)* ','? | 'default' ','?) '=>' expr ;
items = (item? ',')* item? ;
item = '...' expr | 'amp'? expr ('=>' 'amp'? expr)? ;
suffix = '[' expr? ']' | '{' expr '}' | ('->' | '?->') (name | var | '{' expr '}') | '::' (name | var | '{' expr '}' | 'class') | args ;
istring = 'is(' (expr 'is-')* 'is)' ;
"""

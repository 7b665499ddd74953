"""The rows that the fixture queries must give, one to a line, columns cut by bars, ``-`` for null.

Those of ``extract_repairs`` were written by hand from the sources before any run; the others were written out from a run
and then read line by line against the sources in ``fixtures``. In DuckDB they are the twins of these queries.
"""

from __future__ import annotations

ROWS: dict[str, tuple[str, str]] = {
    "extract_repairs_symbols": ("file varchar, name varchar, kind varchar, line int, col int, is_definition boolean, scope varchar, data_type varchar, decl_type varchar, signature varchar, return_type varchar, storage varchar, arity int, param_types varchar", """
old.c|fold|function|0|4|true||||fold(xs, n)|int||2|int,long
old.c|lid|field|5|21|true|jar_t||int||||-|
old.c|jar_t|typedef|5|35|true|||||||-|
old.c|jar_alias|typedef|6|25|true|||||||-|
old.c|pour_t|typedef|7|21|true|||||||-|
pot.cpp|Pot|class|0|6|true|||||||-|
pot.cpp|Pot|function|2|2|true||||Pot(int n)|||1|int
pot.cpp|held|field|4|6|true|Pot||int||||-|
pot.cpp|weigh|function|6|22|true||||shop::shelf::Pot::weigh(int by)|int||1|int
pot.cpp|shop|namespace|7|10|true|||||||-|
pot.cpp|shelf|namespace|7|16|true|||||||-|
pot.cpp|count|global_variable|7|28|true|||int||||-|
"""),
    "extract_repairs_refs": ("file varchar, line int, col int, name varchar, role varchar, is_local boolean, enclosing_func varchar, owner varchar, obj_chain varchar", """
pot.cpp|0|6|Pot|type|false|-||
pot.cpp|2|2|Pot|value|false|Pot||
pot.cpp|2|10|n|value|true|Pot||
pot.cpp|2|15|held|field|false|Pot||
pot.cpp|2|20|n|value|true|Pot||
pot.cpp|2|25|fill|value|false|Pot||
pot.cpp|2|30|n|value|true|Pot||
pot.cpp|3|11|Pot|value|false|-||
pot.cpp|4|6|held|field|false|-|Pot|
pot.cpp|6|4|shop|namespace|false|weigh||
pot.cpp|6|10|shelf|namespace|false|weigh||
pot.cpp|6|17|Pot|namespace|false|weigh||
pot.cpp|6|22|weigh|value|false|weigh||
pot.cpp|6|32|by|value|true|weigh||
pot.cpp|6|45|held|value|false|weigh||
pot.cpp|6|52|by|value|true|weigh||
pot.cpp|7|10|shop|namespace|false|-||
pot.cpp|7|16|shelf|namespace|false|-||
pot.cpp|7|28|count|value|false|-||
"""),
    "extract_repairs_calls": ("file varchar, line int, col int, caller varchar, callee varchar", """
pot.cpp|2|25|Pot|fill
"""),
    "extract_repairs_locals": ("file varchar, func varchar, name varchar, kind varchar, line int, col int, data_type varchar, decl_type varchar", """
old.c|fold|xs|parameter|1|5||int
old.c|fold|n|parameter|1|14||long
pot.cpp|Pot|n|parameter|2|10||int
pot.cpp|weigh|by|parameter|6|32||int
"""),
    "extract_repairs_aliases": ("file varchar, name varchar, target varchar", """
old.c|jar_alias|jar
"""),
    "extract_fixture_symbols": ("file varchar, name varchar, kind varchar, line int, col int, is_definition boolean, scope varchar, data_type varchar, decl_type varchar, signature varchar, return_type varchar, storage varchar, arity int, param_types varchar", """
geo.hpp|geo|namespace|0|10|true|||||||-|
geo.hpp|Shape|class|1|6|true|||||||-|
geo.hpp|sides|function|3|6|true||||sides()|int||-|
geo.hpp|operator==|field|4|7|true|Shape||bool||||-|
geo.hpp|n|field|5|6|true|Shape||int||||-|
geo.hpp|Count|typedef|7|6|true|||||||-|
geo.hpp|twice|function|8|23|true||||twice(T v)|T||1|T
geo.hpp|c_api|prototype|10|17|false||||c_api(int a)|int||1|int
geo.hpp|~Shape|function|11|13|true||||geo::Shape::~Shape()|||-|
main.c|mode|enum|1|5|true|||||||-|
main.c|FAST|enumerator|1|12|true|||||||-|
main.c|SLOW|enumerator|1|18|true|||||||-|
main.c|run|function|2|11|true||||run(point_t *p)|int|static|1|point_t
main.c|done|label|5|0|true|||||||-|
main.c|main|function|8|4|true||||main(void)|int||0|
odd.c|hook_t|typedef|0|15|true|||||||-|
odd.c|on_exit|global_variable|1|7|true|||void (*)(int)||||-|
odd.c|level|global_variable|2|11|false|||int|||extern|-|
odd.c|reg|struct|3|7|true|||||||-|
odd.c|on|field|3|22|true|reg||unsigned||||-|
odd.c|raw|field|3|56|true|reg||int||||-|
odd.c|lo|field|3|75|true|@anon:odd.c:3:61||char||||-|
odd.c|half|field|3|81|true|reg|@anon:odd.c:3:61|struct { char lo; }||||-|
odd.c|bank|global_variable|4|11|true||reg|struct reg||||-|
odd.c|probe|function|5|18|true||||probe(struct reg *r, ...)|int|static|1|struct reg,...
point.c|origin|global_variable|1|8|true||point_t|point_t||||-|
point.c|area|function|2|4|true||||area(const point_t *p, int scale)|int||2|point_t,int
point.h|POINT_H|macro|1|8|true|||||||-|
point.h|point|struct|2|7|true|||||||-|
point.h|x|field|2|19|true|point||int||||-|
point.h|y|field|2|26|true|point||int||||-|
point.h|next|field|2|43|true|point|point|struct point||||-|
point.h|point_t|typedef|3|21|true|||||||-|
point.h|origin|global_variable|4|15|false||point_t|point_t|||extern|-|
point.h|area|prototype|5|4|false||||area(const point_t *p, int scale)|int||2|point_t,int
wrapped.c|gCounter|global_variable|0|16|true|||||||-|
wrapped.c|gTable|global_variable|1|23|true|||||||-|
wrapped.c|RESET|prototype|2|5|false||||RESET(void)|void||0|
"""),
    "extract_fixture_refs": ("file varchar, line int, col int, name varchar, role varchar, is_local boolean, enclosing_func varchar, owner varchar, obj_chain varchar", """
geo.hpp|0|10|geo|namespace|false|-||
geo.hpp|1|6|Shape|type|false|-||
geo.hpp|3|6|sides|value|false|sides||
geo.hpp|3|29|n|field|false|sides|Shape|@type:Shape
geo.hpp|4|24|Shape|type|false|-||
geo.hpp|4|31|o|value|false|-||
geo.hpp|5|6|n|field|false|-|Shape|
geo.hpp|7|6|Count|type|false|-||
geo.hpp|8|18|T|type|false|twice||
geo.hpp|8|21|T|type|false|twice||
geo.hpp|8|23|twice|value|false|twice||
geo.hpp|8|29|T|type|false|twice||
geo.hpp|8|31|v|value|true|twice||
geo.hpp|8|43|v|value|true|twice||
geo.hpp|8|47|v|value|true|twice||
geo.hpp|10|17|c_api|value|false|-||
geo.hpp|10|27|a|value|false|-||
geo.hpp|11|0|geo|namespace|false|~Shape||
geo.hpp|11|5|Shape|namespace|false|~Shape||
geo.hpp|11|13|Shape|value|false|~Shape||
geo.hpp|11|23|release|value|false|~Shape||
main.c|1|5|mode|type|false|-||
main.c|1|12|FAST|value|false|-||
main.c|1|18|SLOW|value|false|-||
main.c|2|11|run|value|false|run||
main.c|2|15|point_t|type|false|run||
main.c|2|24|p|value|true|run||
main.c|3|9|p|value|true|run||
main.c|3|17|done|label|false|run||
main.c|4|11|area|value|false|run||
main.c|4|16|p|value|true|run||
main.c|4|19|SLOW|value|false|run||
main.c|4|27|run|value|false|run||
main.c|4|31|p|value|true|run||
main.c|4|34|next|field|false|run|point_t|p
main.c|5|0|done|label|false|run||
main.c|6|11|origin|value|false|run||
main.c|6|18|x|field|false|run||origin
main.c|8|4|main|value|false|main||
main.c|8|24|run|value|false|main||
main.c|8|29|origin|value|false|main||
odd.c|0|15|hook_t|type|false|-||
odd.c|0|27|code|value|false|-||
odd.c|1|7|on_exit|value|false|-||
odd.c|2|11|level|value|false|-||
odd.c|3|7|reg|type|false|-||
odd.c|3|22|on|field|false|-|reg|
odd.c|3|56|raw|field|false|-|reg|
odd.c|3|75|lo|field|false|-|@anon:odd.c:3:61|
odd.c|3|81|half|field|false|-|reg|
odd.c|4|7|reg|type|false|-||
odd.c|4|11|bank|value|false|-||
odd.c|4|21|on|field|false|-|reg|@type:reg
odd.c|4|30|half|field|false|-|reg|@type:reg
odd.c|4|40|lo|field|false|-|@anon:odd.c:3:61|@type:reg half
odd.c|5|18|probe|value|false|probe||
odd.c|5|31|reg|type|false|probe||
odd.c|5|36|r|value|true|probe||
odd.c|6|18|reg|type|false|probe||
odd.c|6|24|r|value|true|probe||
odd.c|6|28|half|field|false|probe|reg|@type:reg
odd.c|6|33|lo|field|false|probe|@anon:odd.c:3:61|@type:reg half
odd.c|6|38|pick|value|false|probe||
odd.c|6|43|r|value|true|probe||
odd.c|6|47|on|field|false|probe||@call:pick
point.c|1|0|point_t|type|false|-||
point.c|1|8|origin|value|false|-||
point.c|1|20|x|field|false|-|point_t|@type:point_t
point.c|1|28|y|field|false|-|point_t|@type:point_t
point.c|2|4|area|value|false|area||
point.c|2|15|point_t|type|false|area||
point.c|2|24|p|value|true|area||
point.c|2|31|scale|value|true|area||
point.c|4|8|total|value|true|area||
point.c|4|16|p|value|true|area||
point.c|4|19|x|field|false|area|point_t|p
point.c|4|23|p|value|true|area||
point.c|4|26|y|field|false|area|point_t|p
point.c|5|4|total|value|true|area||
point.c|5|13|p|value|true|area||
point.c|5|16|next|field|false|area|point_t|p
point.c|5|22|x|field|false|area||p next
point.c|6|11|total|value|true|area||
point.c|6|19|scale|value|true|area||
point.h|0|8|POINT_H|value|false|-||
point.h|1|8|POINT_H|value|false|-||
point.h|2|7|point|type|false|-||
point.h|2|19|x|field|false|-|point|
point.h|2|26|y|field|false|-|point|
point.h|2|36|point|type|false|-||
point.h|2|43|next|field|false|-|point|
point.h|3|15|point|type|false|-||
point.h|3|21|point_t|type|false|-||
point.h|4|7|point_t|type|false|-||
point.h|4|15|origin|value|false|-||
point.h|5|4|area|value|false|-||
point.h|5|15|point_t|type|false|-||
point.h|5|24|p|value|false|-||
point.h|5|31|scale|value|false|-||
wrapped.c|0|0|U32|type|false|-||
wrapped.c|0|4|SECTION_VAR|value|false|-||
wrapped.c|0|16|gCounter|type|false|-||
wrapped.c|1|0|point_t|type|false|-||
wrapped.c|1|8|PLACED|value|false|-||
wrapped.c|1|15|ALIGNED|type|false|-||
wrapped.c|1|23|gTable|value|false|-||
wrapped.c|1|38|FAST|type|false|-||
wrapped.c|2|5|RESET|value|false|-||
"""),
    "extract_fixture_calls": ("file varchar, line int, col int, caller varchar, callee varchar", """
geo.hpp|11|23|~Shape|release
main.c|4|11|run|area
main.c|4|27|run|run
main.c|8|24|main|run
odd.c|6|38|probe|pick
"""),
    "extract_fixture_locals": ("file varchar, func varchar, name varchar, kind varchar, line int, col int, data_type varchar, decl_type varchar", """
geo.hpp|twice|v|parameter|8|31|T|T
main.c|run|p|parameter|2|24|point_t|point_t
odd.c|probe|r|parameter|5|36|reg|struct reg
point.c|area|p|parameter|2|24|point_t|point_t
point.c|area|scale|parameter|2|31||int
point.c|area|total|local_variable|4|8||int
"""),
    "extract_fixture_aliases": ("file varchar, name varchar, target varchar", """
point.h|point_t|point
"""),
    "grep_fixture_symbols": ("file varchar, name varchar, kind varchar, line int, col int, is_definition boolean, scope varchar, data_type varchar, decl_type varchar, signature varchar, return_type varchar, storage varchar, arity int, param_types varchar", """
main.c|mode|enum|1|5|true|||||||-|
main.c|run|function|2|11|true|||||||-|
main.c|done|label|5|0|true|||||||-|
odd.c|on_exit|global_variable|1|7|true|||||||-|
odd.c|reg|struct|3|7|true|||||||-|
odd.c|re|struct|4|7|true|||||||-|
odd.c|probe|function|5|18|true|||||||-|
odd.c|re|struct|5|31|true|||||||-|
odd.c|re|struct|6|18|true|||||||-|
point.h|POINT_H|macro|1|8|true|||||||-|
point.h|point|struct|2|7|true|||||||-|
point.h|poin|struct|2|36|true|||||||-|
point.h|poin|struct|3|15|true|||||||-|
point.h|point_t|typedef|3|21|true|||||||-|
point.h|area|prototype|5|4|false|||||||-|
wrapped.c|gCounter|global_variable|0|16|true|||||||-|
wrapped.c|gTable|global_variable|1|23|true|||||||-|
wrapped.c|RESET|prototype|2|5|false|||||||-|
"""),
    "grep_fixture_refs": ("file varchar, line int, col int, name varchar, role varchar, is_local boolean, enclosing_func varchar, owner varchar, obj_chain varchar", """
geo.hpp|0|10|geo||false|-||
geo.hpp|1|6|Shape||false|-||
geo.hpp|3|6|sides||false|-||
geo.hpp|3|29|n|field|false|-||
geo.hpp|4|2|bool||false|-||
geo.hpp|4|24|Shape||false|-||
geo.hpp|4|31|o||false|-||
geo.hpp|5|6|n||false|-||
geo.hpp|7|6|Count||false|-||
geo.hpp|8|18|T||false|-||
geo.hpp|8|21|T||false|-||
geo.hpp|8|23|twice||false|-||
geo.hpp|8|29|T||false|-||
geo.hpp|8|31|v||false|-||
geo.hpp|8|43|v||false|-||
geo.hpp|8|47|v||false|-||
geo.hpp|10|8|C||false|-||
geo.hpp|10|17|c_api||false|-||
geo.hpp|10|27|a||false|-||
geo.hpp|11|0|geo||false|-||
geo.hpp|11|5|Shape||false|-||
geo.hpp|11|13|Shape||false|-||
geo.hpp|11|23|release||false|-||
main.c|0|1|include||false|-||
main.c|0|10|point||false|-||
main.c|0|16|h|field|false|-||
main.c|1|5|mode||false|-||
main.c|1|12|FAST||false|-||
main.c|1|18|SLOW||false|-||
main.c|2|11|run||false|run||
main.c|2|15|point_t||false|run||
main.c|2|24|p||false|run||
main.c|3|9|p||false|run||
main.c|3|17|done||false|run||
main.c|4|11|area||false|run||
main.c|4|16|p||false|run||
main.c|4|19|SLOW||false|run||
main.c|4|27|run||false|run||
main.c|4|31|p||false|run||
main.c|4|34|next|field|false|run||
main.c|5|0|done||false|run||
main.c|6|11|origin||false|run||
main.c|6|18|x|field|false|run||
main.c|8|4|main||false|-||
main.c|8|24|run||false|-||
main.c|8|29|origin||false|-||
odd.c|0|15|hook_t||false|-||
odd.c|0|27|code||false|-||
odd.c|1|7|on_exit||false|-||
odd.c|2|11|level||false|-||
odd.c|3|7|reg||false|-||
odd.c|3|22|on||false|-||
odd.c|3|56|raw||false|-||
odd.c|3|75|lo||false|-||
odd.c|3|81|half||false|-||
odd.c|3|92|__packed||false|-||
odd.c|4|7|reg||false|-||
odd.c|4|11|bank||false|-||
odd.c|4|21|on|field|false|-||
odd.c|4|30|half|field|false|-||
odd.c|4|40|lo|field|false|-||
odd.c|5|11|__init||false|probe||
odd.c|5|18|probe||false|probe||
odd.c|5|31|reg||false|probe||
odd.c|5|36|r||false|probe||
odd.c|6|18|reg||false|probe||
odd.c|6|24|r||false|probe||
odd.c|6|28|half|field|false|probe||
odd.c|6|33|lo|field|false|probe||
odd.c|6|38|pick||false|probe||
odd.c|6|43|r||false|probe||
odd.c|6|47|on|field|false|probe||
point.c|0|1|include||false|-||
point.c|0|10|point||false|-||
point.c|0|16|h|field|false|-||
point.c|1|0|point_t||false|-||
point.c|1|8|origin||false|-||
point.c|1|20|x|field|false|-||
point.c|1|28|y|field|false|-||
point.c|2|4|area||false|-||
point.c|2|15|point_t||false|-||
point.c|2|24|p||false|-||
point.c|2|31|scale||false|-||
point.c|4|8|total||false|-||
point.c|4|16|p||false|-||
point.c|4|19|x|field|false|-||
point.c|4|23|p||false|-||
point.c|4|26|y|field|false|-||
point.c|5|4|total||false|-||
point.c|5|13|p||false|-||
point.c|5|16|next|field|false|-||
point.c|5|22|x|field|false|-||
point.c|6|11|total||false|-||
point.c|6|19|scale||false|-||
point.h|0|1|ifndef||false|-||
point.h|0|8|POINT_H||false|-||
point.h|1|1|define||false|-||
point.h|1|8|POINT_H||false|-||
point.h|2|7|point||false|-||
point.h|2|19|x||false|-||
point.h|2|26|y||false|-||
point.h|2|36|point||false|-||
point.h|2|43|next||false|-||
point.h|3|15|point||false|-||
point.h|3|21|point_t||false|-||
point.h|4|7|point_t||false|-||
point.h|4|15|origin||false|-||
point.h|5|4|area||false|-||
point.h|5|15|point_t||false|-||
point.h|5|24|p||false|-||
point.h|5|31|scale||false|-||
point.h|6|1|endif||false|-||
wrapped.c|0|0|U32||false|-||
wrapped.c|0|4|SECTION_VAR||false|-||
wrapped.c|0|16|gCounter||false|-||
wrapped.c|1|0|point_t||false|-||
wrapped.c|1|8|PLACED||false|-||
wrapped.c|1|15|ALIGNED||false|-||
wrapped.c|1|23|gTable||false|-||
wrapped.c|1|38|FAST||false|-||
wrapped.c|2|5|RESET||false|-||
"""),
    "grep_fixture_calls": ("file varchar, line int, col int, caller varchar, callee varchar", """
geo.hpp|3|6|-|sides
geo.hpp|8|23|-|twice
geo.hpp|10|17|-|c_api
geo.hpp|11|13|-|Shape
geo.hpp|11|23|-|release
main.c|2|11|run|run
main.c|4|11|run|area
main.c|4|27|run|run
main.c|8|4|-|main
main.c|8|24|-|run
odd.c|5|18|probe|probe
odd.c|6|38|probe|pick
point.c|2|4|-|area
point.h|5|4|-|area
wrapped.c|1|15|-|ALIGNED
wrapped.c|2|5|-|RESET
"""),
    "macro_wrapped_vars": ("file varchar, name varchar, kind varchar, line int, col int, is_definition boolean, scope varchar, data_type varchar, decl_type varchar, signature varchar, return_type varchar, storage varchar, arity int, param_types varchar", """
wrapped.c|gCounter|global_variable|0|16|true|||||||-|
wrapped.c|gTable|global_variable|1|23|true|||||||-|
wrapped.c|RESET|prototype|2|5|false||||RESET(void)|void||0|
"""),
    "goto_definition_fixture": ("req_id int, word varchar, file varchar, line int, col int, kind varchar, name varchar, status varchar", """
0|x|point.h|2|19|field|x|hit
1|next|point.h|2|43|field|next|hit
2|area|point.c|2|4|function|area|hit
3|origin|point.c|1|8|global_variable|origin|hit
4|y|point.h|2|26|field|y|hit
5|done|main.c|5|0|label|done|hit
6|run|main.c|2|11|function|run|hit
"""),
    "references_fixture": ("req_id int, file varchar, line int, col int, role varchar", """
0|main.c|6|18|field
0|point.c|1|20|field
0|point.c|4|19|field
0|point.c|5|22|field
0|point.h|2|19|field
1|main.c|4|34|field
1|point.c|5|16|field
1|point.h|2|43|field
2|main.c|4|11|value
2|point.c|2|4|value
2|point.h|5|4|value
3|main.c|6|11|value
3|main.c|8|29|value
3|point.c|1|8|value
3|point.h|4|15|value
4|point.c|1|28|field
4|point.c|4|26|field
4|point.h|2|26|field
5|main.c|3|17|label
5|main.c|5|0|label
6|main.c|2|11|value
6|main.c|4|27|value
6|main.c|8|24|value
"""),
    "code_insight_fixture": ("req_id int, category varchar, label varchar, value varchar, file varchar, line int, col int", """
0|Definition|point.h:3|field|point.h|2|19
0|References|main.c:7|field|main.c|6|18
0|References|point.c:2|field|point.c|1|20
0|References|point.c:5|field|point.c|4|19
0|References|point.c:6|field|point.c|5|22
0|References|point.h:3|field|point.h|2|19
0|Symbol|Kind|field|-|-|-
0|Symbol|Defined in|point.h:3|point.h|2|19
1|Definition|point.h:3|field|point.h|2|43
1|References|main.c:5|field|main.c|4|34
1|References|point.c:6|field|point.c|5|16
1|References|point.h:3|field|point.h|2|43
1|Symbol|Kind|field|-|-|-
1|Symbol|Defined in|point.h:3|point.h|2|43
1|Type|point.h:3|struct|point.h|2|7
2|Called by|run||main.c|4|11
2|Declaration|point.h:6|prototype|point.h|5|4
2|Definition|point.c:3|function|point.c|2|4
2|References|main.c:5|value|main.c|4|11
2|References|point.c:3|value|point.c|2|4
2|References|point.h:6|value|point.h|5|4
2|Symbol|Kind|function, function prototype|-|-|-
2|Symbol|Signature|int area(const point_t *p, int scale)|-|-|-
2|Symbol|Defined in|point.c:3|point.c|2|4
2|Symbol|Declared in|point.h:6|point.h|5|4
3|Declaration|point.h:5|global_variable|point.h|4|15
3|Definition|point.c:2|global_variable|point.c|1|8
3|References|main.c:7|value|main.c|6|11
3|References|main.c:9|value|main.c|8|29
3|References|point.c:2|value|point.c|1|8
3|References|point.h:5|value|point.h|4|15
3|Symbol|Kind|global variable|-|-|-
3|Symbol|Storage|extern|-|-|-
3|Symbol|Defined in|point.c:2|point.c|1|8
3|Symbol|Declared in|point.h:5|point.h|4|15
3|Type|point.h:3|struct|point.h|2|7
4|Definition|point.h:3|field|point.h|2|26
4|References|point.c:2|field|point.c|1|28
4|References|point.c:5|field|point.c|4|26
4|References|point.h:3|field|point.h|2|26
4|Symbol|Kind|field|-|-|-
4|Symbol|Defined in|point.h:3|point.h|2|26
5|Definition|main.c:6|label|main.c|5|0
5|References|main.c:4|label|main.c|3|17
5|References|main.c:6|label|main.c|5|0
5|Symbol|Kind|label|-|-|-
5|Symbol|Defined in|main.c:6|main.c|5|0
6|Called by|run|recursive|main.c|4|27
6|Called by|main||main.c|8|24
6|Calls|area||main.c|4|11
6|Calls|run|recursive|main.c|4|27
6|Definition|main.c:3|function|main.c|2|11
6|References|main.c:3|value|main.c|2|11
6|References|main.c:5|value|main.c|4|27
6|References|main.c:9|value|main.c|8|24
6|Symbol|Kind|function|-|-|-
6|Symbol|Signature|static int run(point_t *p)|-|-|-
6|Symbol|Defined in|main.c:3|main.c|2|11
"""),
    "symbol_info_fixture": ("req_id int, pos int, label varchar, value varchar, file varchar, line int, col int", """
0|0|Kind|field|-|-|-
0|2|Defined in|point.h:3|point.h|2|19
1|0|Kind|field|-|-|-
1|2|Defined in|point.h:3|point.h|2|43
2|0|Kind|function, function prototype|-|-|-
2|1|Signature|int area(const point_t *p, int scale)|-|-|-
2|2|Defined in|point.c:3|point.c|2|4
2|3|Declared in|point.h:6|point.h|5|4
3|0|Kind|global variable|-|-|-
3|1|Storage|extern|-|-|-
3|2|Defined in|point.c:2|point.c|1|8
3|3|Declared in|point.h:5|point.h|4|15
4|0|Kind|field|-|-|-
4|2|Defined in|point.h:3|point.h|2|26
5|0|Kind|label|-|-|-
5|2|Defined in|main.c:6|main.c|5|0
6|0|Kind|function|-|-|-
6|1|Signature|static int run(point_t *p)|-|-|-
6|2|Defined in|main.c:3|main.c|2|11
"""),
    "category_counts_fixture": ("req_id int, category varchar, n_rows bigint", """
0|Definition|1
0|References|5
0|Symbol|2
1|Definition|1
1|References|3
1|Symbol|2
1|Type|1
2|Called by|1
2|Declaration|1
2|Definition|1
2|References|3
2|Symbol|4
3|Declaration|1
3|Definition|1
3|References|4
3|Symbol|4
3|Type|1
4|Definition|1
4|References|3
4|Symbol|2
5|Definition|1
5|References|2
5|Symbol|2
6|Called by|2
6|Calls|2
6|Definition|1
6|References|3
6|Symbol|3
"""),
    "type_info_fixture": ("req_id int, text varchar, tag varchar", """
0|int|
1|struct point|point
3|point_t|point_t
4|int|
"""),
}


def sql(name: str) -> str:
    """The rows as a SELECT of values."""
    columns, text = ROWS[name]
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)

    def value(v: str, kind: str) -> str:
        return "null" if v == "-" else v if kind in ("int", "bigint", "boolean") else "'" + v.replace("'", "''") + "'"

    rows = ["(" + ", ".join(value(v, k) for v, k in zip(line.split("|"), kinds, strict=True)) + ")" for line in text.strip("\n").split("\n")]
    shown = ", ".join(f"cast({n} as {k}) as {n}" for n, k in zip(names, kinds, strict=True))
    return f"select {shown} from (values {', '.join(rows)}) t({', '.join(names)})"

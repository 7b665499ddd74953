"""Fixed word sets of the C and C++ languages that names are tested against."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reserved words of C (C89 to C23) and C++, standard literal macros, preprocessor words and standard
# integer types. They are never user symbols.
C_WORDS = """
auto break case char const continue default do double else enum extern float for goto if int long register return short
signed sizeof static struct switch typedef union unsigned void volatile while inline restrict _Bool _Complex _Imaginary
_Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local alignas alignof bool constexpr false nullptr
static_assert thread_local true typeof typeof_unqual _BitInt _Decimal32 _Decimal64 _Decimal128
""".split()
CPP_WORDS = """
and and_eq asm bitand bitor catch char8_t char16_t char32_t class compl concept consteval constinit const_cast co_await
co_return co_yield decltype delete dynamic_cast explicit export friend mutable namespace new noexcept not not_eq operator
or or_eq private protected public reinterpret_cast requires static_cast template this throw try typeid typename using
virtual wchar_t xor xor_eq
""".split()
LITERAL_WORDS = "NULL TRUE FALSE EOF".split()
DIRECTIVE_WORDS = "define include ifdef ifndef endif elif undef pragma defined".split()
STANDARD_TYPES = """
int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t size_t ssize_t ptrdiff_t intptr_t uintptr_t wchar_t
char16_t char32_t
""".split()
CONTEXT_WORDS = "override final".split()
HARD = frozenset(C_WORDS + CPP_WORDS + LITERAL_WORDS + DIRECTIVE_WORDS + STANDARD_TYPES + CONTEXT_WORDS)

# Type macros of Windows and firmware code. They look like keywords but may be user symbols.
SOFT = frozenset("""
BOOL BOOLEAN VOID BYTE WORD DWORD QWORD CHAR UCHAR SHORT USHORT LONG ULONG INT UINT FLOAT DOUBLE WCHAR TCHAR HANDLE LPVOID
LPSTR LPCSTR INT8 INT16 INT32 INT64 UINT8 UINT16 UINT32 UINT64 U8 U16 U32 U64 S8 S16 S32 S64
""".split())

# The smaller word set of the line scanner.
SCANNER = frozenset("""
if else for while do switch case default return goto break continue sizeof typedef struct union enum const static extern
volatile register unsigned signed void char short int long float double inline restrict _Bool typeof asm auto class
namespace template typename public private protected virtual override final new delete this operator using friend explicit
mutable constexpr nullptr true false try catch throw
""".split())

# Words that a wrapped variable's name cannot be.
WRAPPED_NOT = frozenset("""
void char short int long float double signed unsigned _Bool bool const volatile struct union enum static extern register
auto restrict inline typedef return
""".split())


def is_hard_keyword(word: Column) -> Column:
    return word.isin(*sorted(HARD))


def is_soft_keyword(word: Column) -> Column:
    return word.isin(*sorted(SOFT))

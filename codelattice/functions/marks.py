"""What marks a symbol as an entry point or as touching security: conventions of frameworks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decorators by which frameworks call a function, in either case but for those of the second list.
ENTRY_DECORATORS = [
    r"app\.(get|post|put|delete|patch|route|websocket|on_event)",
    r"router\.(get|post|put|delete|patch|route)",
    r"blueprint\.(route|before_request|after_request)",
    r"(before|after)_(request|response)",
    r"click\.(command|group)",
    r"\w+\.(command|group)\b",
    r"(field|model)_(serializer|validator)",
    r"(celery\.)?(task|shared_task|periodic_task)",
    r"receiver",
    r"api_view",
    r"\baction\b",
    r"(override_settings|modify_settings)",
    r"(event\.)?listens_for",
    r"(Get|Post|Put|Delete|Patch|RequestMapping)Mapping",
    r"(Scheduled|EventListener|Bean|Configuration)",
    r"(Component|Injectable|Controller|Module|Guard|Pipe)",
    r"(Subscribe|Mutation|Query|Resolver)",
    r"@(Override|OnLifecycleEvent|Composable)",
    r"(HiltViewModel|AndroidEntryPoint|Inject)",
    r"\w+\.(tool|tool_plain|system_prompt|result_validator)\b",
    r"\w+\.(middleware|exception_handler|on_exception)\b",
    r"\w+\.route\b",
]
EXACT_DECORATORS = [r"pytest\.(fixture|mark)", r"(app|router)\.(get|post|put|delete|patch|use|all)\b", r"^tool\b"]
# Names by which frameworks and runtimes call a function.
ENTRY_NAMES = [
    r"^main$",
    r"^__main__$",
    r"^test_",
    r"^Test[A-Z]",
    r"^on_",
    r"^handle_",
    r"^handler$",
    r"^handle$",
    r"^lambda_handler$",
    r"^upgrade$",
    r"^downgrade$",
    r"^lifespan$",
    r"^get_db$",
    r"^on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive)",
    r"^do(Get|Post|Put|Delete)$",
    r"^do_(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$",
    r"^log_message$",
    r"^(middleware|errorHandler)$",
    r"^ng(OnInit|OnChanges|OnDestroy|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked)$",
    r"^(transform|writeValue|registerOnChange|registerOnTouched|setDisabledState)$",
    r"^(canActivate|canDeactivate|canActivateChild|canLoad|canMatch|resolve)$",
    r"^(componentDidMount|componentDidUpdate|componentWillUnmount|shouldComponentUpdate|render)$",
]
# Parts of names that touch security.
SECURITY_WORDS = [
    "auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "query", "execute", "connect",
    "socket", "request", "http", "sanitize", "validate", "encrypt", "decrypt", "hash", "sign", "verify", "admin", "privilege",
]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def entry_name(name: Column, more: list[str] = ()) -> Column:
    """Whether a function's name is a conventional entry point's, or matches one of the caller's patterns."""
    return name.rlike(any_of([*ENTRY_NAMES, *more]))


def entry_decorator(decorators: Column, more: list[str] = ()) -> Column:
    """Whether one of an array of decorators (without `@`) is a framework's, or matches one of the caller's patterns. Null and empty arrays have none."""
    found = F.exists(decorators, lambda d: d.rlike(f"(?i){any_of(ENTRY_DECORATORS)}") | d.rlike(any_of([*EXACT_DECORATORS, *more])))
    return F.coalesce(found, F.lit(False))


def security(*names: Column, more: list[str] = ()) -> Column:
    """Whether one of the names holds a security word, in either case."""
    found = F.lit(False)
    for n in names:
        found = found | F.coalesce(F.lower(n).rlike("|".join([*SECURITY_WORDS, *more])), F.lit(False))
    return found

"""Word lists that results depend on."""

# fixed values
GENERIC = (
    "task", "cancellationtoken", "fact", "theory", "inlinedata", "memberdata", "guid", "string", "int", "bool", "void", "object", "var", "double", "long",
    "float", "decimal", "byte", "char", "datetime", "datetimeoffset", "timespan", "func", "action", "predicate", "ienumerable", "list", "ilist", "dictionary",
    "idictionary", "icollection", "exception", "task<bool>", "task<guid>", "httpclient", "httpcontext", "httprequest", "httpresponse", "jsonserializeroptions",
    "imapper", "iconfiguration", "iserviceprovider", "irequest", "irequesthandler", "ivalidator", "abstractvalidator", "trequest", "tresponse", "tresult", "tkey",
    "tvalue", "tentity", "tcommand", "stringcomparison", "jsonelement", "jsondocument", "type", "nullable",
)
FRAMEWORK = ("handle", "handleasync", "invoke", "invokeasync", "dispose", "disposeasync", "tostring", "equals", "gethashcode", "configure", "configureservices", "onmodelcreating", "main", "buildtargetmodel")
STRUCTURAL = ("calls", "references", "method", "contains", "imports", "imports_from", "implements", "inherits", "defines", "re_exports")
DEPENDENCY = ("calls", "references", "imports", "imports_from", "implements", "inherits")
CONTAINMENT = ("contains", "method", "defines")
FLOW = ("calls", "method", "contains")
SOFT = ("conceptually_related_to", "semantically_similar_to", "shares_data_with", "rationale_for")
ROUTING = ("impl_of", "handles", "handled_by")
REF_ONLY = ("references", "imports", "imports_from")
FRONT_EXT = ("tsx", "jsx", "ts", "js", "mjs", "cjs", "vue", "svelte", "css", "scss", "sass", "less", "html")
BACK_EXT = ("cs", "py", "go", "java", "kt", "rb", "php", "rs", "scala", "ex", "exs", "c", "cc", "cpp", "h", "hpp", "swift")
FRONT_DIRS, BACK_DIRS = ("frontend", "client", "web", "webapp", "ui"), ("backend", "server", "api")
NONPROD_DIRS = ("migrations", "obj", "bin", "node_modules", "dist", "__generated__")
NONSOURCE_EXT = (".csproj", ".props", ".sln", ".json", ".xml", ".yml", ".yaml", ".md", ".txt", ".sh", ".env", ".config", ".lock")
FAMILY = ("Handler", "Validator", "Command", "Query", "Endpoint", "Response", "Request", "Result")
DOC_TYPES = ("document", "concept", "rationale")
CONTRACT = "(?i)(Dto|Contract|Request|Response|Command|Query|Payload)"
LITERAL = 0.45

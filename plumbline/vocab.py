"""Fixed values the results depend on: vocabularies, lookup tables and patterns."""

# Closed vocabulary of event types.
EVENT_TYPES = (
    "project.generated",
    "skill.invoked",
    "ci.run",
    "tool.executed",
    "knowledge.created",
    "knowledge.used",
)

# Output counter of the summary for each plain event type.
SUMMARY_COUNTERS = {
    "project.generated": "projects_generated",
    "skill.invoked": "skills_invoked",
    "tool.executed": "tools_executed",
    "knowledge.created": "knowledge_created",
    "knowledge.used": "knowledge_used",
}

# Language by lower-cased file extension.
LANGUAGE_BY_EXTENSION = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript/React",
    ".jsx": "JavaScript/React",
    ".c": "C",
    ".h": "C/C++ Header",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".hpp": "C++ Header",
    ".cs": "C#",
    ".java": "Java",
    ".go": "Go",
    ".rs": "Rust",
    ".rb": "Ruby",
    ".php": "PHP",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".scala": "Scala",
    ".lua": "Lua",
    ".sh": "Shell",
    ".ps1": "PowerShell",
    ".bat": "Batch",
    ".vbs": "VBScript",
    ".asm": "Assembly",
    ".s": "Assembly",
}

# Build system by exact file name.
BUILD_SYSTEM_BY_NAME = {
    "package.json": "npm/Node.js",
    "pom.xml": "Maven/Java",
    "build.gradle": "Gradle/Java",
    "Cargo.toml": "Cargo/Rust",
    "CMakeLists.txt": "CMake/C++",
    "Makefile": "Make",
    "setup.py": "setuptools/Python",
    "pyproject.toml": "Python/pyproject",
    "requirements.txt": "pip/Python",
    "go.mod": "Go modules",
    "Gemfile": "Bundler/Ruby",
    "composer.json": "Composer/PHP",
}

# Build system by extension (case-sensitive).
BUILD_SYSTEM_BY_EXTENSION = {
    ".csproj": "MSBuild/C#",
    ".sln": "Visual Studio",
    ".vcxproj": "Visual Studio/C++",
}

# Substring pattern, description, category.
TECHNOLOGY_PATTERNS = (
    ("SCardEstablishContext", "PC/SC: Establish context", "winscard"),
    ("SCardConnect", "PC/SC: Connect to card", "winscard"),
    ("SCardTransmit", "PC/SC: Send APDU", "winscard"),
    ("SCardDisconnect", "PC/SC: Disconnect", "winscard"),
    ("SCardBeginTransaction", "PC/SC: Begin transaction", "winscard"),
    ("SCardEndTransaction", "PC/SC: End transaction", "winscard"),
    ("SCardGetStatusChange", "PC/SC: Poll reader state change", "winscard"),
    ("SCardListReaders", "PC/SC: List available readers", "winscard"),
    ("SCardControl", "PC/SC: Send control/escape command", "winscard"),
    ("winscard", "WinSCard library import/link", "winscard"),
    ("pcsclite", "PC/SC Lite (Linux/macOS)", "pcsc-linux"),
    ("ISO15693", "ISO 15693 Vicinity Card protocol", "nfc"),
    ("ISO14443", "ISO 14443 Proximity Card protocol", "nfc"),
    ("APDU", "Application Protocol Data Unit", "nfc"),
    ("ACR122", "ACR122U NFC reader", "nfc"),
    ("libnfc", "libnfc library", "nfc"),
    ("nfc_open", "libnfc: open device", "nfc"),
    ("nfc_initiator", "libnfc: initiator mode", "nfc"),
    ("FF000000", "ACR122U escape command prefix", "nfc"),
    ("libusb", "LibUSB direct USB access", "usb"),
    ("hidapi", "HIDAPI (HID device access)", "usb"),
    ("WinUSB", "WinUSB driver", "usb"),
    ("DeviceIoControl", "Windows: DeviceIoControl", "winapi"),
    ("CreateFile", "Windows: CreateFile (device handle)", "winapi"),
    ("SetupDiGetClassDevs", "Windows: Device enumeration", "winapi"),
    ("RegisterDeviceNotification", "Windows: Device hotplug events", "winapi"),
    ("CM_Register_Notification", "Windows: PnP notifications", "winapi"),
)

# Platform by category, first hit wins.
PLATFORM_PRIORITY = (
    ("winscard", "Windows"),
    ("winapi", "Windows"),
    ("pcsc-linux", "Linux/Unix"),
    ("nfc", "Cross-platform NFC"),
)

# Directories a corpus scan leaves out.
IGNORED_DIRECTORIES = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build",
    "target", ".idea", ".vs", ".vscode", "bin", "obj", ".cache",
)

# The shorter directory list of the duplicate and manifest scans.
IGNORED_DIRECTORIES_SHORT = (".git", "node_modules", "venv", "__pycache__", "dist", "build")

# Extensions the near-duplicate scan takes (case-sensitive).
DUPLICATE_SCAN_EXTENSIONS = (
    ".py", ".js", ".ts", ".java", ".cs", ".cpp", ".c", ".go", ".rb", ".php", ".rs",
)

# Known external functions by API group.
API_GROUPS = {
    "winscard": (
        "SCardEstablishContext", "SCardReleaseContext", "SCardConnect", "SCardDisconnect",
        "SCardReconnect", "SCardBeginTransaction", "SCardEndTransaction", "SCardTransmit",
        "SCardControl", "SCardGetStatusChange", "SCardListReaders", "SCardGetAttrib",
        "SCardSetAttrib", "SCardStatus", "SCardFreeMemory",
    ),
    "libnfc": (
        "nfc_open", "nfc_close", "nfc_init", "nfc_exit", "nfc_initiator_init",
        "nfc_initiator_select_passive_target", "nfc_initiator_deselect_target",
        "nfc_initiator_transceive_bytes", "nfc_device_set_property_bool",
        "nfc_device_get_name", "nfc_list_devices",
    ),
    "libusb": (
        "libusb_init", "libusb_exit", "libusb_open", "libusb_close",
        "libusb_get_device_list", "libusb_get_device_descriptor",
        "libusb_open_device_with_vid_pid", "libusb_claim_interface",
        "libusb_bulk_transfer", "libusb_control_transfer", "libusb_interrupt_transfer",
        "libusb_release_interface",
    ),
    "winapi": (
        "CreateFile", "CloseHandle", "ReadFile", "WriteFile", "DeviceIoControl",
        "SetupDiGetClassDevs", "SetupDiEnumDeviceInterfaces",
        "SetupDiGetDeviceInterfaceDetail", "RegisterDeviceNotification",
        "CM_Register_Notification",
    ),
    "hidapi": (
        "hid_open", "hid_close", "hid_read", "hid_write", "hid_send_feature_report",
        "hid_get_feature_report", "hid_enumerate", "hid_free_enumeration", "hid_init",
        "hid_exit",
    ),
}

# Words that look like calls but are not, by language.
CALL_KEYWORDS = {
    "c": ("if", "while", "for", "switch", "return", "sizeof", "typeof", "alignof",
          "static_assert", "catch", "throw"),
    "js": ("if", "while", "for", "switch", "return", "typeof", "instanceof", "new", "delete",
           "void", "throw", "catch", "import", "require"),
    "csharp": ("if", "while", "for", "foreach", "switch", "return", "new", "throw", "catch",
               "typeof", "nameof", "sizeof"),
    "generic": ("if", "while", "for", "switch", "return", "new", "throw", "import", "from",
                "class", "def", "function"),
}

# Words a C function definition cannot be named.
C_DEFINITION_KEYWORDS = ("if", "while", "for", "switch", "return")

# File names that mark an entry module.
PYTHON_ENTRY_NAMES = ("__main__.py", "main.py", "app.py", "run.py", "cli.py")
JS_ENTRY_NAMES = ("index.js", "index.ts", "main.js", "main.ts", "app.js", "app.ts")

# Suffixes a language-specific parser accepts.
C_SUFFIXES = (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp")
JS_SUFFIXES = (".js", ".ts", ".jsx", ".tsx")

# Words after FROM/JOIN/UPDATE/INTO that are not table names.
SQL_NOT_TABLES = ("SELECT", "INSERT", "UPDATE", "DELETE", "VALUES")

# One-line description of what a procedure does.
SQL_SUMMARY_REFRESH = "Full Refresh: Clears and repopulates target table."
SQL_SUMMARY_MERGE = "Upsert: Synchronizes source and target data."
SQL_SUMMARY_TRANSFER = "Data Transfer: Transformation and ingestion into target table."
SQL_SUMMARY_QUERY = "Data Retrieval: Pure query or view definition."
SQL_SUMMARY_UNREADABLE = "Procedural Logic"

# Command rules in order, first match wins. Words before a name are one run of characters, not a repeated group, which recurses.
COMMAND_RULES = (
    ("GITOPS-001", r"git\s+push\s+(?:[-\w][-\w\s]*\s)?origin\s+(?:master|main)\b"),
    ("GITOPS-002", r"\bgit\s+merge\b"),
    ("GITOPS-003", r"gh\s+pr\s+merge\b.*--admin"),
    ("GITOPS-004", r"(?i)gh\s+api\b.*\bbranches/(?:master|main)/protection\b.*(PUT|DELETE|PATCH)"),
    ("GITOPS-005", r"\bgit\s+tag\b"),
)

# Tokens that switch a policy off for one change.
COMMAND_BYPASS = "[skip-gitops]"
RECORD_BYPASS = ("[skip-adr]", "--skip-adr")
VERSION_BYPASS = "[skip-semver]"

# What needs a design record, and head-branch prefixes by base branch.
RECORD_DIRECTORY = "docs/adr"
RECORD_EXTENSIONS = (".py", ".sh", ".yml", ".yaml")
BRANCH_PREFIXES = {
    "main": ("staging", "release/", "hotfix/"),
    "staging": ("feature/", "hotfix/", "release/", "chore/", "docs/", "fix/"),
}

# Permitted slug form, catalog states and administrator role.
SLUG_PATTERN = r"^[a-z0-9]+(-[a-z0-9]+)*$"
ADMIN_ROLE = "platform-admin"

"""Word lists of the engine."""

# Fixed values.
WEAK_VALUES = (
    "changeme change-me change_me password passwd pwd secret admin root test testing example placeholder todo tbd fixme "
    "your-password your_password your-secret your_secret your-api-key your_api_key my-secret abc123 123456 12345678 "
    "qwerty letmein hunter2 default undefined null none empty insert-key-here"
).split()
HOSTILE_NAMES = (
    "LD_PRELOAD LD_LIBRARY_PATH LD_AUDIT LD_DEBUG DYLD_INSERT_LIBRARIES DYLD_LIBRARY_PATH DYLD_FRAMEWORK_PATH "
    "DYLD_ROOT_PATH NODE_OPTIONS NODE_REPL_EXTERNAL_MODULE NODE_PATH BASH_ENV ENV SHELLOPTS BASHOPTS IFS PS4 "
    "PROMPT_COMMAND PERL5OPT PERL5LIB RUBYOPT RUBYLIB PYTHONSTARTUP PYTHONPATH PYTHONHOME PYTHONWARNINGS GLIBC_TUNABLES "
    "JAVA_TOOL_OPTIONS _JAVA_OPTIONS JDK_JAVA_OPTIONS CLASSPATH PATH"
).split()
RESERVED_NAMES = (
    "HOME USER USERNAME LOGNAME SHELL PWD OLDPWD HOSTNAME TERM LANG LC_ALL LC_CTYPE EDITOR VISUAL PAGER DISPLAY TMPDIR "
    "TEMP TMP XDG_CONFIG_HOME XDG_DATA_HOME XDG_CACHE_HOME XDG_RUNTIME_DIR SYSTEMROOT WINDIR COMSPEC PATHEXT PROGRAMFILES "
    "USERPROFILE HOMEDRIVE HOMEPATH APPDATA LOCALAPPDATA ALLUSERSPROFILE PUBLIC NUMBER_OF_PROCESSORS "
    "PROCESSOR_ARCHITECTURE PROCESSOR_IDENTIFIER OS JAVA_HOME GOPATH GOROOT VIRTUAL_ENV CONDA_PREFIX GEM_HOME CARGO_HOME"
).split()
EXAMPLE_FILES = (
    ".env.example .env.sample .env.template .env.dist env.example env.sample env.template env.dist *.env.example "
    "*.env.sample *.env.template *.env.dist **/.env.example **/.env.sample **/.env.template **/.env.dist"
).split()
CI_ENVIRONMENT_KINDS = {
    "production": "production", "prod": "production", "staging": "production", "preview": "production",
    "development": "dev", "dev": "dev", "test": "test", "testing": "test", "qa": "test", "ci": "test",
}
DECLARING_KINDS = ["compose-environment", "dockerfile-env", "ci-env"]
CI_KINDS = ["ci-secret", "ci-var", "ci-env"]
EXAMPLE_BASENAMES = (
    ".env.example .env.example.local .env.sample .env.sample.local .env.template .env.dist"
).split()
EXAMPLE_GLOBS = (
    ".env.example* .env.sample* .env.template* .env.dist* *.env.example* *.env.sample* *.env.template* *.env.dist*"
).split()
HYGIENE_EXAMPLES = ".env.example .env.sample .env.template .env.dist".split()
FRAMEWORK_PREFIXES = [
    ("REACT_APP_", ["react-scripts", "react", "next", "expo"]),
    ("VUE_APP_", ["vue", "@vue/cli-service"]),
    ("VITE_", ["vite"]),
    ("NEXT_PUBLIC_", ["next"]),
    ("NUXT_PUBLIC_", ["nuxt", "@nuxt/kit"]),
    ("GATSBY_", ["gatsby"]),
]
AMBIENT_NAMES = (
    "PATH HOME PWD OLDPWD SHELL LANG LC_ALL LC_CTYPE LANGUAGE TZ TERM TERMINFO TMPDIR TEMP TMP USER LOGNAME HOSTNAME "
    "EDITOR VISUAL PAGER DISPLAY SSH_AUTH_SOCK XDG_CONFIG_HOME XDG_DATA_HOME XDG_CACHE_HOME XDG_RUNTIME_DIR "
    "XDG_SESSION_TYPE DBUS_SESSION_BUS_ADDRESS MAIL SHLVL COLUMNS LINES PS1 HISTSIZE SYSTEMROOT WINDIR COMSPEC PATHEXT "
    "USERPROFILE HOMEDRIVE HOMEPATH APPDATA LOCALAPPDATA ALLUSERSPROFILE PUBLIC PROGRAMFILES PROGRAMFILES(X86) "
    "COMMONPROGRAMFILES COMMONPROGRAMFILES(X86) PROGRAMDATA PROGRAMW6432 PSMODULEPATH COMPUTERNAME USERNAME "
    "NUMBER_OF_PROCESSORS PROCESSOR_ARCHITECTURE PROCESSOR_IDENTIFIER PROCESSOR_REVISION PROCESSOR_LEVEL OS NODE_ENV "
    "NODE_DEBUG NPM_CONFIG_LOGLEVEL NPM_CONFIG_PREFIX NPM_CONFIG_REGISTRY NPM_CONFIG_USERCONFIG NPM_CONFIG_CACHE "
    "NPM_LIFECYCLE_EVENT NPM_PACKAGE_NAME NPM_VERSION INIT_CWD CI CONTINUOUS_INTEGRATION BUILD_NUMBER BUILD_ID "
    "BUILD_VCS_NUMBER CI_COMMIT_SHA CI_JOB_ID CI_PROJECT_ID CI_PIPELINE_ID GITHUB_ACTIONS GITHUB_WORKFLOW GITHUB_RUN_ID "
    "GITHUB_RUN_NUMBER GITHUB_REPOSITORY GITHUB_REF GITHUB_SHA GITHUB_HEAD_REF GITHUB_BASE_REF GITHUB_EVENT_NAME "
    "GITHUB_ACTOR GITHUB_WORKSPACE GITHUB_SERVER_URL GITHUB_API_URL GITHUB_OUTPUT GITHUB_ENV GITHUB_PATH "
    "GITHUB_STEP_SUMMARY RUNNER_OS RUNNER_ARCH RUNNER_NAME RUNNER_TEMP RUNNER_TOOL_CACHE RUNNER_DEBUG RUNNER_TRACKING_ID "
    "TF_BUILD BUILD_BUILDID BUILD_SOURCEVERSION TEAMCITY_VERSION APPVEYOR CIRCLECI CIRCLE_BRANCH CIRCLE_SHA1 TRAVIS "
    "TRAVIS_COMMIT DRONE BUILDKITE BUILDKITE_BUILD_ID CODEBUILD_BUILD_ID CODEBUILD_BUILD_ARN JENKINS_URL JENKINS_HOME "
    "HUDSON_URL AGENT_NAME AGENT_ID AGENT_WORKFOLDER TFVC SYSTEM_TEAMPROJECTID NO_COLOR FORCE_COLOR CLICOLOR "
    "CLICOLOR_FORCE COLORTERM EDITOR_VISUAL SSL_CERT_FILE SSL_CERT_DIR HTTP_PROXY HTTPS_PROXY NO_PROXY http_proxy "
    "https_proxy no_proxy PYENV_VERSION VIRTUAL_ENV_DISABLE_PROMPT GOPATH GOCACHE GOMODCACHE CARGO_HOME RUSTUP_HOME "
    "JAVA_HOME GRADLE_USER_HOME GEM_HOME GEM_PATH BASH_ENV ENV SHELLOPTS BASHOPTS"
).split()
PLACEHOLDER_PASSWORDS = (
    "password pass passwd secret changeme change-me change_me xxx user postgres example placeholder mypassword "
    "yourpassword letmein"
).split()
DEBUG_NAMES = (
    "DEBUG DEBUG_MODE DEBUGGER VERBOSE TRACE LOG_LEVEL LOG_VERBOSITY APP_ENV NODE_ENV ENV RAILS_ENV AUTH_DISABLED "
    "DISABLE_AUTH BYPASS_AUTH SKIP_AUTH NO_AUTH MOCK MOCKING HOT_RELOAD DEV_TOOLS STORYBOOK"
).split()
DEBUG_VALUES = "true 1 yes on enabled debug trace verbose development dev local test".split()
SECRET_NAME = (
    "(SECRET|TOKEN|PASSWORD|PASSWD|PWD|API_?KEY|PRIVATE_?KEY|ACCESS_?KEY|CREDENTIAL|AUTH_?KEY|SESSION_?KEY|CLIENT_?SECRET|"
    "ENCRYPTION|SALT|CERT_?KEY|SIGNING_?KEY|INTERNAL_?(SIGNING_)?KEY|DATABASE_?URL|DSN)"
)
PLACEHOLDER_VALUE = r"^your[-_ ]|^<.*>\z|^\$\{|^x+\z|^todo\z|^changeme\z|^replace[-_ ]me"

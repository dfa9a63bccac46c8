"""Where results go: terminal text, JSON, SARIF, markdown and dotenv files."""

"""Where graphs come from: tables per type, triple stores, YAML schemas."""

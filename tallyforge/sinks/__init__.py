"""Writers with a contract: created once, unchanged, or refused."""

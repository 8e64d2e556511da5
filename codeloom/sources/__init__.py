"""Where tables come from and where they go: files, repositories, artifacts."""

"""Where rows come from: image folders, label files, result extracts, recogniser stages."""

"""Readers: folders of files, text bodies, paired lists, session history."""

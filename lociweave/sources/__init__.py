"""Readers of profiles and writers of matrices and trees."""

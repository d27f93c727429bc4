"""photoloom.images"""

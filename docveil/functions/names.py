"""Given names by which a person's name is recognised without a role or title. Our own list of frequent Turkish given names;
those that are common words too are in AMBIGUOUS."""

GIVEN = (
    "Ahmet Ali Alper Arda Arzu Asena Aslı Asuman Atakan Ayça Ayhan Aykut Ayla Aylin Ayşe Ayşegül Aysun Aziz Banu Beril Berk Berna Betül Bilge Burak Burcu "
    "Bülent Cansu Cem Cemal Cemile Ceyda Ceylan Çağla Çetin Defne Didem Dilara Ebru Ece Efe Elif Emel Emine Emre Engin Ercan Erdal Eren Erhan Erkan Erol "
    "Esra Evren Ezgi Fadime Fahri Faruk Fatih Fatma Ferhat Feride Figen Filiz Fikret Funda Furkan Gamze Gökhan Gözde Gülay Gülcan Gülşen Hakan Halil "
    "Haluk Hamza Handan Hasan Hatice Havva Hilal Hülya Hüseyin İbrahim İlhan İlker İsmail Kaan Kadir Kemal Kerem Kübra Leyla Mehmet Melek Melike Meltem "
    "Mert Meryem Mesut Metin Murat Musa Mustafa Nalan Nazlı Necla Neslihan Nihat Nilüfer Nuray Nuri Okan Onur Orhan Osman Ömer Özge Özlem Pelin Pınar "
    "Ramazan Recep Rukiye Sedat Selim Selin Semra Serap Serkan Sevgi Sevim Sezen Sibel Sinan Süleyman Şebnem Şerife Şule Tamer Tarık Tolga Tuba Turgut "
    "Tülay Uğur Volkan Yasemin Yasin Yeliz Yusuf Zehra Zeynep"
).split()
AMBIGUOUS = frozenset("Bilge Cem Çetin Defne Ece Efe Engin Evren Hilal Melek Metin Onur Pınar Sevgi Uğur Berk Ceylan Aziz".split())
